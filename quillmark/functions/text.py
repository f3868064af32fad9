"""Column expressions over strings: normalising, hashing, terms, trigrams, redaction, classification.

All stay inside generated code or Catalyst's higher-order functions; the two that need Unicode normal forms are
Arrow-batched and say so.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u4e00-\\u9fff"
MAX_TERMS, WIDTHS = 80, (2, 3, 4)
TRIGRAM_THRESHOLD = 0.3


def strip(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def token_estimate(c: Column) -> Column:
    """Half the stripped characters, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(strip(c)) / F.lit(2.0))).cast("long")


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name in a namespace, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def lock_key(c: Column) -> Column:
    """First eight bytes of the SHA-256, big-endian, signed."""
    return F.conv(F.substring(sha256(c), 1, 16), 16, -10).cast("long")


def keyword_terms(c: Column) -> Column:
    """Lower-cased words of two characters or more and runs of CJK with their 2- to 4-grams; longest first, then by
    value, MAX_TERMS at most."""
    tokens = F.regexp_extract_all(c, F.lit(f"[A-Za-z0-9_]+|[{CJK}]+"), F.lit(0))
    han = F.filter(tokens, lambda t: t.rlike(f"^[{CJK}]"))
    words = F.transform(F.filter(tokens, lambda t: ~t.rlike(f"^[{CJK}]") & (F.length(t) >= 2)), F.lower)

    def grams(n: int) -> Column:
        longer = F.filter(han, lambda t: F.length(t) >= n)
        return F.flatten(F.transform(longer, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))))

    terms = F.array_distinct(F.concat(words, han, *map(grams, WIDTHS)))
    ordered = F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("k"), t.alias("t"))))
    return F.slice(F.transform(ordered, lambda s: s["t"]), 1, MAX_TERMS)


def trigrams(c: Column) -> Column:
    """The different trigrams of the lower-cased words, each padded by two blanks before and one after.

    With three blanks between padded words, a trigram is any three characters that do not end in two blanks. One expression
    finds them all; the point after it takes a whole character, also one outside the basic plane."""
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "   "), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?=(..[^ ]|.[^ ] ))."), F.lit(1)))


def may_have_few_trigrams(c: Column, most: int) -> Column:
    """False only for texts that have more than `most` trigrams, which the start of a longer text tells already. Cut inside
    a word it has a few trigrams that the text has not: the one at its end, and those of a sigma that looks like a last one."""
    start = 2 * most + 16
    return (F.char_length(c) <= start) | (F.size(trigrams(F.substring(c, 1, start))) <= most + 5)


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams, of two trigram arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays, in doubles; null for a zero vector or unequal lengths."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


# What counts as a credential, and what stands in its place.
CREDENTIAL = r"(?i)(password|passwd|pwd|token|secret|api[_-]?key)\s*[:=]\s*([^;,&\s]+)"
URL_CREDENTIAL = r"(?i)(://[^:/\s]+:)[^@/\s]+@"
URL_PARAMETER = r"(?i)([?&](?:token|key|signature|sig|credential)=)[^&#\s]+"
SECRET_NAME = r"(?i)(password|passwd|pwd|token|secret|api[_-]?key|credential)"
HIDDEN = "[REDACTED]"


def redact(c: Column) -> Column:
    """Without quotes around it and credentials in it; above 180 characters the first 177 and dots."""
    clean = F.regexp_replace(strip(c), "^[\"'`]+|[\"'`]+$", "")
    clean = F.regexp_replace(clean, CREDENTIAL, f"$1={HIDDEN}")
    clean = F.regexp_replace(clean, URL_CREDENTIAL, f"$1{HIDDEN}@")
    clean = F.regexp_replace(clean, URL_PARAMETER, f"$1{HIDDEN}")
    return F.when(F.length(clean) > 180, F.concat(F.substring(clean, 1, 177), F.lit("..."))).otherwise(clean)


def redact_named(name: Column, value: Column) -> Column:
    """Hidden if the name speaks of a secret, else the stripped value's first 500 characters."""
    return F.when(name.rlike(SECRET_NAME), F.lit(HIDDEN)).otherwise(F.substring(strip(F.coalesce(value, F.lit(""))), 1, 500))


# The words by which a question is sent to documents, code facts or both.
BOTH_WORDS = ["是否符合", "规范", "为什么", "问题", "架构", "符合"]
BOTH_TARGETS = ["服务", "项目", "代码", "kafka", "redis"]
DOCUMENT_WORDS = ["制度", "流程", "标准", "规定", "sop", "文档", "权限", "mvp", "上传", "表格", "评测", "切分", "知识库", "content_hash", "embedding"]
CODE_WORDS = ["服务", "项目", "代码", "topic", "框架", "依赖", "调用"]


def has_any(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def route(c: Column) -> Column:
    low = F.lower(c)
    return F.when(has_any(c, BOTH_WORDS) & has_any(low, BOTH_TARGETS), "hybrid").when(has_any(low, DOCUMENT_WORDS), "rag").when(has_any(low, CODE_WORDS), "wiki").otherwise("hybrid")


def line_fingerprint(c: Column) -> Column:
    """A page line for comparison across pages: blanks as one, lower case, page numbers as #."""
    x = F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))
    x = F.regexp_replace(x, r"(?:page\s*)?\d+(?:\s*(?:of|/)\s*\d+)?", "#")
    return F.regexp_replace(x, r"第\s*#\s*页(?:\s*/\s*#)?", "#")


def is_page_number(c: Column) -> Column:
    x = F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    return x.rlike(r"^(?:\d+|page\d+(?:of\d+|/\d+)?|第\d+页(?:/\d+)?)$")


CITATION = r"\[([A-Za-z0-9][A-Za-z0-9_-]{0,80})\]"


def citations(c: Column) -> Column:
    """The different citation ids in brackets, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(CITATION), F.lit(1))))


def is_config_path(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return name.rlike(r".\.(yaml|yml|json|toml|ini|cfg|conf|properties)$") | F.startswith(name, F.lit(".env"))


def identity(fact_type: Column, name: Column, value: Column) -> Column:
    """A fact's name for matching: letters and digits, without the word and the suffixes its type brings along."""
    low = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    host = F.try_parse_url(value, F.lit("HOST"))
    x = low(F.when(F.startswith(fact_type, F.lit("downstream_")) & (name == "") & host.isNotNull(), host).otherwise(name))
    x = F.when(fact_type.isin("downstream_grpc", "client_initialization"), F.regexp_replace(x, "grpc", "")).otherwise(x)
    x = F.when(fact_type == "endpoint_config", F.regexp_replace(x, "(?<=.)(endpoint|target|address|addr|host|port)$", "")).otherwise(x)
    return F.regexp_replace(x, "(?<=.)(serviceclient|servicestub|service|client|stub)$", "")


def inventory_role(path: Column) -> Column:
    """What a project file is for, by name and folder."""
    name, low = F.lower(F.element_at(F.split(path, "/"), -1)), F.lower(path)
    return (
        F.when(low.rlike(r"(^|/)(tests?|__tests__|spec)/") | name.rlike(r"(^test_|_test\.|\.spec\.|\.test\.)"), "test")
        .when(name.isin("dockerfile", "compose.yml", "compose.yaml", "docker-compose.yml", "docker-compose.yaml") | low.rlike(r"(^|/)(helm|charts|k8s|deploy)/"), "deployment")
        .when(name.rlike(r"\.(py|js|jsx|ts|tsx|java|go)$"), "source")
        .when(is_config_path(path), "config")
        .when(name.rlike(r"\.(md|rst|txt|adoc)$"), "documentation")
        .otherwise("other")
    )


def repository_url(c: Column) -> Column:
    """The canonical https address of a repository on the public host, or null: struct<url, owner, name>."""
    m = r"^(?i)https://github\.com/([A-Za-z0-9][A-Za-z0-9-]{0,38})/([A-Za-z0-9._-]+?)(?:\.git)?/?$"
    owner, name = F.regexp_extract(strip(c), m, 1), F.regexp_extract(strip(c), m, 2)
    return F.when((owner != "") & ~name.isin("", ".", ".."), F.struct(F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit(".git")).alias("url"), owner.alias("owner"), name.alias("name")))


def upload_path(c: Column) -> Column:
    """The parts of a relative upload path, or null for absolute ones and those that climb."""
    parts = F.split(F.regexp_replace(c, r"\\", "/"), "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..") | p.rlike("[\\x00-\\x1f]")) | c.rlike("^[A-Za-z]:")
    return F.when(~bad, parts)


def email_key(c: Column) -> Column:
    """NFKC, stripped, case-folded (no built-in does either; Arrow batches)."""

    @F.pandas_udf("string")
    def key(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip().casefold())

    return key(c)


def name_key(c: Column) -> Column:
    """A workspace name for comparison: NFKC, runs of blanks as one, case-folded."""

    @F.pandas_udf("string")
    def key(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold())

    return key(c)


# Shapes of ids and addresses, longest address.
WORKSPACE_ID, UUID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$", r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
EMAIL, LONGEST_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$", 254


def workspace_id(c: Column) -> Column:
    """A workspace's id without blanks around it, null if it has another shape."""
    return F.when(F.trim(c).rlike(WORKSPACE_ID), F.trim(c))


def is_uuid(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(UUID), F.lit(False))


def is_email(key: Column) -> Column:
    """Whether a normalised address can be one."""
    return key.rlike(EMAIL) & (F.char_length(key) <= LONGEST_EMAIL)


def element_of(ref: Column, suffix: Column) -> Column:
    """What a chunk's source reference says: struct<element_type, page, symbol, section_path>."""
    code = suffix.isin("py", "js", "jsx", "ts", "tsx", "go", "java")
    kind = F.when(F.contains(ref, F.lit("#table-")), "table").when(F.startswith(ref, F.lit("page-")), "page_text").when(code, "code").otherwise("section")
    page = F.regexp_extract(ref, r"(?:^|#)page-(\d+)", 1)
    symbol = F.when((kind == "code") & ~ref.isin("code", "module", "module preamble"), ref)
    section = F.when((suffix == "md") & ~F.startswith(ref, F.lit("document")), ref)
    return F.struct(kind.alias("element_type"), F.when(page != "", page.cast("int")).alias("page"), symbol.alias("symbol"), section.alias("section_path"))
