"""10. Personal data: keyed surrogates of the same type and format. DataFrame functions only.

Detected: e-mail addresses, IPv4 addresses, payment cards, IBANs, US social security numbers, phone numbers, secrets after
a key word (password=, token:), and names after a title. Each mention has a canonical form (lower case, digits only, a number of
ten digits without a code as one of +1, a name word for word), and each canonical form one surrogate, so mentions of one
thing stay mentions of one thing in all documents: a word of a name has one surrogate, whether it stands as a given name, as a
surname or alone after a title. A given name's gender is that of all titles before it anywhere; a title without gender, or
titles of both, leave it open. Where a name was found in a text, its words are replaced in the whole text, with a title or
without, wherever they are written with a capital; but a word that the corpus writes in lower case as often as after a title (May,
Will) only beside another word of a name.

A surrogate comes from SHA-256 over the key, the type, the canonical form and an attempt number. It keeps length, separators,
letter case and character class; cards keep their first digit and a valid check digit, IBANs their country and valid check
digits, phones their country code, e-mails get a reserved domain, and names keep their script and the gender of the person.
Surrogates that collide with each other or with any original of their type are drawn again, all but the one of
the least original, until none is left: distinct originals have distinct surrogates, and all words of names are one type. After
NARROW draws a format is taken to be crowded, and each further draw is one character longer, so draws come to an end however many
originals share a short format. The key is a secret of the user's: without it nothing is replaced, as anyone could compute the
surrogates of a known key.

Texts are matched against the patterns once, and once more for lower-case words; only those with a mention are shuffled. Null and empty texts stay as they are;
rows repeat as in the input; other columns pass unchanged, whatever their names, but an input column n_entities gives way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import salted_join, saved

#: Fixed patterns in order of precedence.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{8})(?<=[=:\"']\s{0,3})(?<=(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_-]{8,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<![\d+-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "name": r"(?=\p{Lu})(?<= )(?<=\b(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Mme|Madame|Monsieur|Sr|Sra|Señor|Señora|Господин|Госпожа|Κύριος|Κυρία)\.? )\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){0,2}",
}
FEMALE = r"\b(?:Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora|Госпожа|Κυρία)\.? $"
MALE = r"\b(?:Mr|Herr|Monsieur|Sr|Señor|Господин|Κύριος)\.? $"
#: Syllables and endings of made-up names by script; a feminine name ends in the first ending, others in the second.
SYLLABLES = {
    "latin": ("ba be bo da de di ka ke ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se so ta te ti to va ve vi".split(), "ia", "an"),
    "cyrillic": ("ба бе бо да де ди ка ке ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се со та те ти то ва ве ви".split(), "ия", "ан"),
    "greek": ("βα βε βο δα δε δι κα κε κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σο τα τε τι το".split(), "ία", "ων"),
}
#: Draws of a surrogate that keep the format's length.
NARROW = 4
OPEN, ESCAPE = "\uE000", "\uE001"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every text with a mention has; quicker to look for than the patterns.
GATE = r"[0-9@]|(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]|(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Mme|Madame|Monsieur|Sr|Sra|Señor|Señora|Господин|Госпожа|Κύριος|Κυρία)\.? \p{Lu}"
#: Words and what is between them.
WORDS = r"\p{L}[\p{L}'-]*|[^\p{L}]+"


def _segments(text: Column) -> Column:
    """Plain and mention parts in turn, a plain part first. Marks already in the text are escaped."""
    safe = text
    for i, c in enumerate((ESCAPE, OPEN)):
        safe = F.replace(safe, F.lit(c), F.lit(f"{ESCAPE}{i}"))
    return F.split(F.regexp_replace(safe, f"({ANY})", f"{OPEN}$1{OPEN}"), OPEN, -1)


def _plain(text: Column) -> Column:
    for i, c in reversed(list(enumerate((ESCAPE, OPEN)))):
        text = F.replace(text, F.lit(f"{ESCAPE}{i}"), F.lit(c))
    return text


def _number(hash_hex: Column, base: int) -> Column:
    return F.conv(F.substring(hash_hex, 1, 12), 16, 10).cast("long") % base


def _drawn(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _kind(mention: Column) -> Column:
    out = F.when(mention.rlike(f"^(?:{PATTERNS['email']})$"), "email").when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(mention.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ipv4")
    out = out.when(mention.rlike(rf"^(?:{PATTERNS['iban']})$"), "iban")
    return out.when(mention.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card").when(mention.rlike(r"^[\d+().\s-]+$"), "phone")


def segmented(docs: DataFrame) -> DataFrame:
    """_row: a row of docs as a struct; s: its text's segments and mark: the text's digest, both null without a mention."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.when(F.col("text").rlike(GATE), _segments(F.col("text"))).alias("s"))
    return rows.select("_row", F.when(F.size("s") > 1, F.col("s")).alias("s"), F.when(F.size("s") > 1, F.md5("_row.text")).alias("mark"))


def mentions(hits: DataFrame) -> DataFrame:
    """Mentions of the distinct texts of hits (mark, s) by parts: mark, seg, part, kind, canon, form (as written), and of names given:
    the gender of the title before a given name (0: open), null for surnames and lone names."""
    rows = hits.select("mark", F.explode(F.filter(F.transform("s", lambda x, i: F.struct(i.alias("seg"), x.alias("form"), F.when(i > 0, F.element_at("s", F.greatest(i, F.lit(1)))).alias("before"))), lambda y: y["seg"] % 2 == 1)).alias("y")).select("mark", "y.seg", "y.form", F.substring("y.before", -40, 40).alias("before")).distinct()
    after_key = F.col("before").rlike(r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?$")
    title = F.col("before").rlike(r"\p{L}\.? $") & F.col("form").rlike(r"^\p{Lu}\p{L}")
    kind = F.when(after_key, "secret").when(title & ~F.col("form").rlike(r"[\d@]"), "name").otherwise(F.coalesce(_kind(F.col("form")), F.lit("secret")))
    gender = F.when(F.col("before").rlike(FEMALE), 1).when(F.col("before").rlike(MALE), 2).otherwise(0)
    words = F.split("form", " ")
    parts = F.when(F.col("kind") == "name", F.transform(words, lambda w, i: F.struct(w.alias("form"), F.when(i < F.size(words) - 1, gender).alias("given"))))
    parts = parts.otherwise(F.array(F.struct(F.col("form").alias("form"), F.lit(None).cast("int").alias("given"))))
    rows = rows.withColumn("kind", kind).select("mark", "seg", "kind", F.posexplode(parts).alias("part", "p")).select("mark", "seg", "part", "kind", "p.*")
    digits = F.regexp_replace("form", r"\D", "")
    national = F.when(F.col("form").startswith("+"), F.concat(F.lit("+"), digits)).when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).otherwise(digits)
    canon = F.when(F.col("kind").isin("card", "ssn"), digits).when(F.col("kind") == "phone", national).when(F.col("kind") == "iban", F.replace("form", F.lit(" "), F.lit(""))).when(F.col("kind").isin("secret", "ipv4"), F.col("form")).otherwise(F.lower("form"))
    return rows.withColumn("canon", canon)


def common_words(docs: DataFrame, found: DataFrame) -> DataFrame:
    """canon of the words of names that the texts write in lower case at least as often as names do."""
    named = found.where("kind = 'name'").groupBy("canon").agg(F.count("*").alias("named"))
    lower = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}'-])\p{Ll}[\p{L}'-]*"), F.lit(0))).alias("canon")).groupBy("canon").agg(F.count("*").alias("n"))
    return lower.join(named, "canon").where("n >= named").select("canon", F.lit(True).alias("common"))


def _luhn(digits: Column) -> Column:
    """The digit that makes digits a valid number when it is put at the end."""
    rev = F.split(F.reverse(digits), "")
    total = F.aggregate(F.transform(rev, lambda d, i: F.when(i % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)).otherwise(d.cast("int"))), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def _iban_check(country: Column, rest: Column) -> Column:
    chars = F.split(F.concat(rest, country, F.lit("00")), "")
    value = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string")))
    mod = F.aggregate(value, F.lit(0), lambda a, v: (F.concat(a.cast("string"), v).cast("int")) % 97)
    return F.lpad((98 - mod).cast("string"), 2, "0")


def _masked(key: str, text: Column, hexadecimal: Column) -> Column:
    """text with each ASCII letter and digit drawn again within its class; other characters stay."""
    draw = lambda i: _drawn(key, F.col("kind"), F.col("canon"), F.col("attempt"), i)
    pick = lambda i, start, n: F.chr(F.lit(ord(start)) + _number(draw(i), n))
    one = lambda c, i: F.when(c.rlike("[0-9]"), pick(i, "0", 10)).when(c.rlike("[a-z]"), F.when(hexadecimal, pick(i, "a", 6)).otherwise(pick(i, "a", 26))).when(c.rlike("[A-Z]"), F.when(hexadecimal, pick(i, "A", 6)).otherwise(pick(i, "A", 26))).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _surrogate(key: str) -> Column:
    canon, kind = F.col("canon"), F.col("kind")
    no = F.lit(False)
    wider = F.greatest(F.col("attempt") - (NARROW - 1), F.lit(0))
    more = lambda char: F.repeat(F.lit(char), wider)
    masked = _masked(key, F.concat(canon, F.when(kind == "secret", F.when(canon.rlike("[a-z]"), more("a")).otherwise(more("0"))).when(kind == "iban", more("0")).when(kind.isin("phone", "card", "ssn"), more("0")).otherwise("")), no)
    local = F.substring_index(canon, "@", 1)
    label = _masked(key, F.concat(F.lit("@"), F.split(F.element_at(F.split(canon, "@"), 2), r"\.")[0], more("a")), no)
    octet = lambda i: (1 + _number(_drawn(key, kind, canon, F.col("attempt"), F.lit(f"o{i}")), 254)).cast("string")
    body = F.concat(F.substring(canon, 1, 1), F.expr("substring(_masked, 2, length(_masked) - 2)"))
    card = F.concat(body, _luhn(body))
    iban_rest = F.expr("substring(_masked, 5, length(_masked))")
    iban = F.concat(F.substring(canon, 1, 2), _iban_check(F.substring(canon, 1, 2), iban_rest), iban_rest)
    # +1 and +7 are codes of one digit; other codes are taken as two
    code = F.when(canon.startswith("+1") | canon.startswith("+7"), 2).when(canon.startswith("+"), 3).otherwise(0)
    phone = F.concat(canon.substr(F.lit(1), code), F.col("_masked").substr(code + 1, F.length("_masked")))
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def name(which: str) -> Column:
        syl, fem, other = SYLLABLES[which]
        bag = F.array(*[F.lit(s) for s in syl])
        made = F.transform(F.sequence(F.lit(1), 2 + F.col("attempt")), lambda i: F.element_at(bag, (_number(_drawn(key, kind, canon, F.col("attempt"), i), len(syl)) + 1).cast("int")))
        return F.concat(F.array_join(made, ""), F.when(F.col("style") == 1, fem).when(F.col("style") == 2, other).otherwise(""))

    named = F.when(script == "cyrillic", name("cyrillic")).when(script == "greek", name("greek")).otherwise(name("latin"))
    out = F.when(kind == "email", F.concat(_masked(key, local, no), label, F.lit(".example.com"))).when(kind == "ipv4", F.concat_ws(".", *[octet(i) for i in range(4)]))
    out = out.when(kind == "card", card).when(kind == "iban", iban).when(kind == "phone", phone).when(kind == "ssn", F.concat(F.lit("9"), F.expr("substring(_masked, 2, length(_masked))")))
    out = out.when(kind == "secret", F.when(canon.rlike("^[0-9a-fA-F]+$"), _masked(key, F.concat(canon, more("0")), F.lit(True))).otherwise(F.col("_masked")))
    return F.struct(masked.alias("_masked")), out.otherwise(named)


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate for each distinct canonical form; distinct within a kind and equal to no original of it."""
    # the gender of a given name: 1 or 2 if its titles agree on one
    taken = found.groupBy("kind", "canon").agg(F.bit_or("given").alias("style"))
    taken = saved(taken, "originals")
    todo, done = taken.withColumn("attempt", F.lit(0)), None
    masked, made = _surrogate(key)
    while True:
        drawn = todo.withColumn("_masked", masked["_masked"]).withColumn("surrogate", made).drop("_masked")
        others = taken.select("kind", F.col("canon").alias("surrogate")).withColumn("clash", F.lit(True))
        if done is not None:
            others = others.union(done.select("kind", "surrogate").withColumn("clash", F.lit(True)))
        least = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("first"))
        judged = drawn.join(least, ["kind", "surrogate"]).join(others.distinct(), ["kind", "surrogate"], "left")
        judged = saved(judged.withColumn("ok", F.col("clash").isNull() & (F.col("canon") == F.col("first"))), "surrogates")
        good = judged.where("ok").select("kind", "canon", "surrogate")
        done = good if done is None else done.union(good)
        todo = judged.where("not ok").select("kind", "canon", "style", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return done


def _rendered(form: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the format of one mention."""
    chars = F.split(form, "")
    # a phone number of ten digits that is written without a country code stays so
    national = (kind == "phone") & ~form.startswith("+") & surrogate.startswith("+")
    plain = F.when(national, F.substring(surrogate, 3, 1 << 20)).otherwise(F.replace(surrogate, F.lit("+"), F.lit("")))

    def seat(keep: str) -> Column:
        """The characters of plain in the places of those of form; what a crowded format is longer by stands at the end."""
        start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
        step = lambda a, c: F.struct(F.concat(a["s"], F.when(c.rlike(keep), plain.substr(a["n"] + 1, F.lit(1))).otherwise(c)).alias("s"), (a["n"] + c.rlike(keep).cast("int")).alias("n"))
        return F.aggregate(chars, start, step, lambda a: F.concat(a["s"], plain.substr(a["n"] + 1, F.length(plain))))

    cased = F.when((form == F.upper(form)) & (form != F.lower(form)), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("card", "ssn", "phone"), seat("[0-9]")).when(kind == "iban", seat("[A-Z0-9]")).when(kind == "email", cased).when(kind.isin("secret", "ipv4"), surrogate).otherwise(_cased(form, surrogate))


def _cased(form: Column, surrogate: Column) -> Column:
    return F.when((form == F.upper(form)) & (F.length(form) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text, and n_entities, the mentions replaced."""
    if not key:
        raise ValueError("surrogates need a secret key")
    rows = saved(segmented(docs), "segments", "zstd")
    hits = rows.where("mark is not null")
    found = saved(mentions(hits.select("mark", "s")), "mentions")
    names = surrogates(found, key)
    new = salted_join(found, names, ["kind", "canon"], "inner", F.xxhash64("mark"))
    new = saved(new.withColumn("new", _rendered(F.col("form"), F.col("kind"), F.col("surrogate"))), "rendered")
    whole = new.groupBy("mark", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "new"))), lambda x: x["new"]), " ").alias("new"))
    of_text = whole.groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("seg", "new"))).alias("_new"))
    # of names their words, for mentions without a title
    words = new.where("kind = 'name'").groupBy("mark", "canon").agg(F.min("surrogate").alias("surrogate"))
    words = salted_join(words, common_words(docs, found), ["canon"], "left", F.xxhash64("mark"))
    words = words.groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("canon", F.struct("surrogate", F.coalesce("common", F.lit(False)).alias("common"))))).alias("_words"))
    of_text = of_text.join(words, "mark", "left")

    out = lambda text, n: [*(text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "n_entities"), n.cast("int").alias("n_entities")]
    clean = rows.where("mark is null").select(*out(F.col("_row.text"), F.lit(0)))
    dirty = salted_join(hits.withColumn("_at", F.xxhash64(F.monotonically_increasing_id())), of_text, ["mark"], "inner", F.col("_at"))

    # the words of plain segments and what is between them; a word's surrogate where it is a known name with a capital and, if
    # it is a common word, a space parts it from another one
    split = F.transform("s", lambda s, i: F.when((i % 2 == 0) & F.col("_words").isNotNull(), F.regexp_extract_all(s, F.lit(f"({WORDS})"))))
    name = lambda w: F.when(w.rlike(r"^\p{Lu}"), F.element_at("_words", F.lower(w)))
    beside = lambda q, i, d: F.coalesce((F.get(q, i + d) == " ") & name(F.get(q, i + 2 * d)).isNotNull(), F.lit(False))

    def known(q: Column) -> Column:
        new = lambda w, i: F.when(~name(w)["common"] | beside(q, i, -1) | beside(q, i, 1), _cased(w, name(w)["surrogate"]))
        return F.transform(q, lambda w, i: F.struct(w.alias("w"), new(w, i).alias("new")))

    dirty = dirty.withColumn("_q", split)
    pieces = F.transform("s", lambda s, i: F.struct(
        F.when(i % 2 == 1, F.element_at("_new", i)).alias("new"),
        F.when(i % 2 == 0, s).alias("plain"),
    ))
    dirty = dirty.select("_row", "_new", F.zip_with(pieces, F.transform("_q", known), lambda p, k: F.struct(p["new"].alias("new"), k.alias("parts"), p["plain"].alias("plain"))).alias("_p"))
    joined = F.transform("_p", lambda p: F.coalesce(p["new"], F.array_join(F.transform(p["parts"], lambda x: F.coalesce(x["new"], x["w"])), ""), p["plain"]))
    more = F.aggregate("_p", F.lit(0), lambda n, p: n + F.coalesce(F.size(F.filter(p["parts"], lambda x: x["new"].isNotNull())), F.lit(0)))
    more = F.greatest(more, F.lit(0))
    return clean.union(dirty.select(*out(_plain(F.array_join(joined, "")), F.size("_new") + more)))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, under the key in spark.quern.pii.key, or this query's test key."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replaced(docs, spark.conf.get("spark.quern.pii.key", "key of the test query"))
