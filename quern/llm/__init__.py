"""Training-data operators: thirteen operators and the stages of a corpus pipeline. Nothing outside this package imports it."""
