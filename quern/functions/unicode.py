"""Functions that need Unicode normal forms, charsets or addresses, as Pandas UDFs: Spark has no built-in for them."""

from __future__ import annotations

import ipaddress
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

#: Curly quotes and their plain forms.
QUOTES = str.maketrans("‘’“”", "''\"\"")
HAN = re.compile("[㐀-䶿一-鿿]")
#: Networks that a fetch may not reach.
BLOCKED = [ipaddress.ip_network(n) for n in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.168.0.0/16 198.18.0.0/15 224.0.0.0/4 240.0.0.0/4 ::1/128 fc00::/7 fe80::/10 ff00::/8".split()]


def _nfkc(t: str | None) -> str:
    return unicodedata.normalize("NFKC", t or "")


@pandas_udf(StringType())
def bare(text: pd.Series) -> pd.Series:
    """F2. NFKC, lower case, plain quotes, letters and digits of any script only."""
    return text.map(lambda t: re.sub(r"[\W_]+", "", _nfkc(t).lower().translate(QUOTES)))


@pandas_udf(StringType())
def normal(text: pd.Series) -> pd.Series:
    """F3. NFKC, lower case, collapsed white space, without signs."""
    return text.map(lambda t: re.sub(r"[^\w一-鿿 ]", "", " ".join(_nfkc(t).lower().split())))


@pandas_udf(StringType())
def casefolded(text: pd.Series) -> pd.Series:
    """F5/F6. Collapsed white space, full case folding."""
    return text.map(lambda t: " ".join((t or "").split()).casefold())


@pandas_udf(StringType())
def _family(text: pd.Series) -> pd.Series:
    def one(t):
        x = re.sub(r"[0-9]+", "<n>", re.sub(r"\"[^\"]*\"|'[^']*'", "<q>", _nfkc(t).casefold().translate(QUOTES)))
        words = x.split()
        return "".join(words)[:12] if HAN.search(x) and len(words) < 5 else " ".join(words[:5])

    return text.map(one)


def family(text: Column) -> Column:
    """F22. Signature of a query family: NFKC and case folded, quoted spans as <q>, digits as <n>, the first five words, or twelve
    characters of a text in Han without so many words, hashed."""
    return F.sha2(_family(text), 256)


def resolved_language(explicit: Column, text: Column) -> Column:
    """F23. An explicit zh or en wins; else zh, en, mixed or unknown by Han (extension A as well) and ASCII letters."""
    t = F.coalesce(text, F.lit(""))
    han, latin = t.rlike(HAN.pattern), t.rlike("[A-Za-z]")
    return F.when(explicit.isin("zh", "en"), explicit).when(han & latin, "mixed").when(han, "zh").when(latin, "en").otherwise("unknown")


@pandas_udf(StringType())
def decoded(content: pd.Series, declared: pd.Series) -> pd.Series:
    """S14. Bytes of a page by the declared charset, UTF-8, GB 18030 or, last, Latin-1: the first that fits."""

    def one(data, charset):
        for c in (charset, "utf-8", "gb18030"):
            try:
                return bytes(data).decode(c) if c else bytes(data).decode("utf-8")
            except (UnicodeDecodeError, LookupError):
                continue
        return bytes(data).decode("latin-1")

    return pd.Series([None if d is None else one(d, c) for d, c in zip(content, declared)])


@pandas_udf(BooleanType())
def blocked_address(address: pd.Series) -> pd.Series:
    """P27. Whether an IPv4 or IPv6 address, a mapped IPv4 one by its inner address, is one that a fetch may not reach. What is no
    address is blocked."""

    def one(a):
        try:
            ip = ipaddress.ip_address((a or "").strip())
        except ValueError:
            return True
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return any(ip.version == n.version and ip in n for n in BLOCKED)

    return address.map(one)


@pandas_udf(StringType())
def redacted_json(text: pd.Series) -> pd.Series:
    """P26/K21. JSON with the values of keys that hold a marker masked, at any depth; what is no JSON stays."""
    import json

    from quern.operators.tables import MARKERS

    def clean(v):
        if isinstance(v, dict):
            return {k: "***" if any(m in k.lower() for m in MARKERS) else clean(x) for k, x in v.items()}
        return [clean(x) for x in v] if isinstance(v, list) else v

    def one(t):
        try:
            return None if t is None else json.dumps(clean(json.loads(t)), ensure_ascii=False)
        except ValueError:
            return t

    return text.map(one)
