"""Scalar functions of text, URLs and money as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "[一-鿿]"
CJK = "[一-鿿぀-ヿ가-힣]"


def normalized(text: Column) -> Column:
    """F4/F5. Lower case with white space collapsed; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def bare(text: Column) -> Column:
    """F2 for ASCII. Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def has_cjk(text: Column) -> Column:
    """F7."""
    return F.coalesce(text, F.lit("")).rlike(CJK)


def language_profile(text: Column) -> Column:
    """F8/F9/F23. zh, en, mixed or unknown by Han and ASCII letters."""
    t = F.coalesce(text, F.lit(""))
    han, latin = t.rlike(HAN), t.rlike("[A-Za-z]")
    return F.when(han & latin, "mixed").when(han, "zh").when(latin, "en").otherwise("unknown")


def estimated_tokens(text: Column) -> Column:
    """F21. CJK characters and a quarter of the others, rounded up."""
    t = F.coalesce(text, F.lit(""))
    other = F.length(F.regexp_replace(t, CJK, ""))
    return (F.length(t) - other + F.ceil(other / 4)).cast("long")


def family(text: Column) -> Column:
    """F22. Signature of a query family: lower case, quoted spans as <q>, digits as <n>, the first five words, hashed."""
    t = normalized(text)
    t = F.regexp_replace(F.regexp_replace(t, '"[^"]*"', "<q>"), "[0-9]+", "<n>")
    return F.sha2(F.array_join(F.slice(F.split(t, " "), 1, 5), " "), 256)


def stable_key(*parts: Column) -> Column:
    """F24. SHA-256 of the parts joined by |."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def model_key(name: Column) -> Column:
    """F17. A model's name without date and variant suffixes."""
    return F.regexp_replace(F.lower(F.trim(name)), "((-[0-9]{4}-[0-9]{2}-[0-9]{2})|(-(latest|preview|beta|exp)))+$", "")


def pages_of(spec: Column, limit: int = 16) -> Column:
    """F18. '1,3-5,8' as sorted distinct page numbers, at most `limit`; parts that are no page or ascending range are left out."""
    parts = F.filter(F.split(F.regexp_replace(spec, " ", ""), ","), lambda p: p.rlike("^[0-9]+(-[0-9]+)?$"))
    lo = lambda p: F.split(p, "-")[0].cast("int")
    hi = lambda p: F.element_at(F.split(p, "-"), -1).cast("int")
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.when(hi(p) >= lo(p), F.sequence(lo(p), hi(p))).otherwise(F.expr("cast(array() as array<int>)")))))), 1, limit)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no user, default port or fragment, path at least /; other schemes as they are."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))
    rest = F.regexp_extract(url, "^[A-Za-z]+://(?:[^/?#@]*@)?([^#]*)", 1)
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    tail = F.regexp_replace(rest, "^[^/?]*", "")
    path = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), host, path)).otherwise(url)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_on(host: Column, domain: str) -> Column:
    """P17. Whether a host is the domain or below it."""
    return (host == domain) | host.endswith("." + domain)


def abbreviated(text: Column, limit: int, head: int, tail: int) -> Column:
    """C15/C16. Head and tail of a long text with the number of characters left out between them."""
    n = F.length(text)
    return F.when(n > limit, F.concat(F.substring(text, 1, head), F.lit("…["), (n - head - tail).cast("string"), F.lit(" omitted]…"), F.right(text, F.lit(tail)))).otherwise(text)


def cost(prompt: Column, completion: Column, prompt_price: Column, completion_price: Column) -> Column:
    """B1. Price per thousand units on both sides, rounded half up to six places."""
    d = lambda c: c.cast("decimal(18,6)")
    return F.round(d(prompt) * d(prompt_price) / 1000 + d(completion) * d(completion_price) / 1000, 6).cast("decimal(18,6)")


def title_of(html: Column) -> Column:
    """S15. The page's title with white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def stripped(html: Column) -> Column:
    """S15/F15. Text of a page by patterns: scripts, styles and the like, comments and tags out, white space collapsed."""
    t = html
    for tag in ("script", "style", "noscript", "template", "head", "nav", "footer", "header", "aside", "form"):
        t = F.regexp_replace(t, rf"(?is)<{tag}[ >].*?</{tag}>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def content_status(title: Column, text: Column, least: int = 200) -> Column:
    """P22. interstitial by its title or its first 160 characters, empty below `least` characters, else usable; in this order."""
    hints = "just a moment|access denied|captcha|are you a robot"
    return F.when(F.lower(title).rlike(hints) | F.lower(F.substring(text, 1, 160)).rlike(hints), "interstitial").when(F.length(text) < least, "empty").otherwise("usable")


def cursor(time: Column, key: Column) -> Column:
    """T7. A place in a list as an opaque URL-safe word."""
    body = F.concat(F.lit('{"t":"'), F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit('","i":"'), key.cast("string"), F.lit('"}'))
    return F.rtrim(F.translate(F.base64(F.encode(body, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def _cursor_body(c: Column) -> Column:
    padded = F.rpad(F.translate(c, "-_", "+/"), F.ceil(F.length(c) / 4).cast("int") * 4, F.lit("="))
    return F.decode(F.unbase64(padded), "UTF-8")


def cursor_time(c: Column) -> Column:
    return F.get_json_object(_cursor_body(c), "$.t").cast("timestamp_ntz")


def cursor_id(c: Column) -> Column:
    return F.get_json_object(_cursor_body(c), "$.i").cast("long")


def redirect_target(url: Column, wrappers: tuple[str, ...]) -> Column:
    """R29. The http(s) target in the q or url parameter of a wrapper host's address, else the address itself."""
    host = host_of(url)
    wrapper = F.lit(False)
    for w in wrappers:
        wrapper = wrapper | host_on(host, w)
    at = lambda k: F.try_url_decode(F.nullif(F.regexp_extract(url, rf"[?&]{k}=([^&#]*)", 1), F.lit("")))
    good = lambda c: F.when(c.rlike("^https?://"), c)
    return F.when(wrapper, F.coalesce(good(at("q")), good(at("url")), url)).otherwise(url)


def without_fence(text: Column) -> Column:
    """F14. The inside of a text that is one fenced block, else the trimmed text."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^```[A-Za-z]*\s*\n?(.*?)\n?```$", "$1"))


def slug(text: Column) -> Column:
    """F19. Lower-case letters and digits joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def safe_name(name: Column, limit: int = 120) -> Column:
    """F19. A file name without path separators, control and reserved characters; never empty."""
    n = F.substring(F.trim(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]+', "_")), 1, limit)
    return F.when(n.isin("", ".", ".."), "file").otherwise(n)


def parts_at(text: Column, marker: str) -> Column:
    """F20. A description's two parts at a marker, trimmed; the second is null without it."""
    p = F.split(text, marker, 2)
    return F.struct(F.trim(p[0]).alias("first"), F.trim(F.get(p, F.lit(1))).alias("second"))


def flag(text: Column) -> Column:
    """F25. Whether a text says true, 1 or yes."""
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes"), F.lit(False))


def pure(text: Column, notes: str = r"^\[(note|system)\]") -> Column:
    """P23. Whether a text is a user's own: no note's prefix, no control character, no JSON object or list."""
    t = F.trim(text)
    json = t.rlike(r"(?s)^(\{.*\}|\[.*\])$") & F.try_parse_json(t).isNotNull()
    return ~(F.lower(t).rlike(notes) | text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]") | json)


def negated(text: Column, words: tuple[str, ...] = ("not", "never", "don't", "without", "no")) -> Column:
    """P24. Whether a text holds a negation as a word."""
    return F.lower(text).rlike(r"(?<![\w'])(?:" + "|".join(words) + r")(?![\w'])")


def should_recall(text: Column, triggers: tuple[str, ...], short: int) -> Column:
    """P25. Whether a query is short or holds a trigger word."""
    hit = F.lit(False)
    for t in triggers:
        hit = hit | F.lower(text).contains(t)
    return (F.length(F.trim(text)) <= short) | hit


def folded(text: Column) -> Column:
    """F3/F5/F6. Collapsed white space and folded case: upper then lower case, which also folds ß, final sigmas and the like."""
    return F.lower(F.upper(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))))
