"""Text analysis as Column builders; all but ``nfkc`` stay in the JVM."""

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
TRACKING = ("utm_source", "utm_campaign", "utm_medium", "fbclid")
#: What tokens are made of; A-Z and 0-9 are among the letters and digits, but named they are found by a table.
_WORD = r"A-Za-z0-9\p{IsAlphabetic}\p{Nd}"
#: Word boundaries are ASCII, whatever the Java version.
ENTITY = r"(?<![A-Za-z0-9_])[A-Z][a-zA-Z0-9]*(?:[- ][A-Z][a-zA-Z0-9]*){0,3}(?![A-Za-z0-9_])"
ENTITY_SKIP = tuple(
    "A An The This These Those That It He She They We You I And But Or However Furthermore Additionally In On At For By With From As If Then There Their Our "
    "Your Its Who What When Where Why How Not No Yes All Some Most Many Each Every Both One Two".split()
)


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC. Spark has no function for it: one Arrow pass, which leaves normal text untouched."""
    return F.pandas_udf(_nfkc, "string")(text)


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[{_WORD}]+"), F.lit(0))


def folded_line(text: Column) -> Column:
    """The folded tokens with spaces between, as one string: what Python takes in a narrow pass. It may begin or end with a space."""
    return fold(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^{_WORD}]+", " "))


def coded_words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of lines (``folded_line``) the words' line numbers, their codes, and the words by code; the empty word is among them."""
    parts = pc.split_pattern(lines, " ")
    coded = parts.flatten().dictionary_encode()
    at = np.repeat(np.arange(len(lines)), np.diff(parts.offsets.to_numpy()))
    return at, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def fold(token: Column) -> Column:
    return F.lower(token)


def is_stop_word(folded: Column) -> Column:
    return folded.isin(*STOP_WORDS)


def stem(word: Column) -> Column:
    """Suffix rules, each on what the one before left: plurals, -ed and -ing, -er, a doubled last letter other than l, s, z."""
    w = F.regexp_replace(word, r"(?<=ss)es$|(?<=i)es$|(?<!s)s$", "")
    w = F.regexp_replace(w, r"(?<!e)ed$|(?<=ee)d$|ing$", "")
    w = F.regexp_replace(w, r"er$", "")
    w = F.regexp_replace(w, r"(?<=.)([^lsz])\1$", "$1")
    # No rule fits another last letter, and most words end before a pattern is tried.
    last = F.substring(word, -1, 1)
    some = last.isin("s", "d", "g", "r") | (last == F.substring(word, -2, 1))
    return F.when((F.length(word) <= 2) | ~some, word).otherwise(w)


def stemmed(word: str) -> str:
    """``stem`` of one word, for passes in Python."""
    if len(word) <= 2 or not (word[-1] in "sdgr" or word[-1] == word[-2]):
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1]
    elif w.endswith("ed"):
        w = w[:-2]
    elif w.endswith("ing"):
        w = w[:-3]
    if w.endswith("er"):
        w = w[:-2]
    return w[:-1] if len(w) > 2 and w[-1] == w[-2] and w[-1] not in "lsz" else w


def analyse(token: Column) -> Column:
    """The index form of a token."""
    return stem(fold(token))


def feature_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def overlap_tokens(text: Column) -> Column:
    """The set of tokens between spaces and ASCII punctuation, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"""[ \t\n\r\f.,;:!?'"()\[\]{}\-/\\]+"""), lambda t: t != ""))


def entities(text: Column) -> Column:
    """Runs of one to four capitalised words whose first isn't a common one, repeats included."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), F.lit(0))
    return F.filter(found, lambda e: ~F.split(e, " ")[0].isin(*ENTITY_SKIP))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def code_hash(token: Column) -> Column:
    """31-polynomial hash of an ASCII string, as a signed 32-bit number."""
    unsigned = F.aggregate(F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda a, x: (a * 31 + x).bitwiseAND(F.lit(4294967295)))
    return F.when(unsigned >= 2147483648, unsigned - 4294967296).otherwise(unsigned)


def host(url: Column) -> Column:
    """The host of a URL; the whole string if it has none."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), url)


def normalize_url(url: Column) -> Column:
    """Canonical http(s) URL, or null: lower-case scheme and host, no default port, fragment, tracking parameter, double or last slash, sorted parameters."""
    u = F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$", 0)
    part = lambda i: F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$", i)
    scheme, user, name, port, path, query = F.lower(part(1)), part(2), F.lower(part(3)), part(4), part(5), part(6)
    port = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(path, "//+", "/")
    path = F.regexp_replace(path, r"(?<=/)\./|/\.$", "")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    path = F.when(path == "", "/").otherwise(path)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~F.lower(F.split(p, "=")[0]).isin(*TRACKING)))
    query = F.array_join(kept, "&")
    made = F.concat(scheme, F.lit("://"), F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""), name, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when((u != "") & scheme.isin("http", "https"), made)


def resolve_url(base: Column, link: Column) -> Column:
    """A link made absolute against its page's URL: absolute, scheme-relative, root-relative, query, fragment or relative to the page's folder."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    bare = F.regexp_replace(base, r"#.*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#") | (link == ""), F.concat(bare, link))
        .when(link.startswith("?"), F.concat(F.regexp_replace(bare, r"\?.*$", ""), link))
        .otherwise(F.concat(folder, link))
    )


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text as numbers."""
    h = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(h), F.lit(1)), F.lit(2)), lambda i: F.conv(F.substr(h, i, F.lit(2)), 16, 10).cast("bigint"))


def fnv1a(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, 32 bits; of the empty text its offset basis."""
    return F.when(text == "", F.lit(2166136261)).otherwise(F.aggregate(_bytes(text), F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295))))


def djb2(text: Column) -> Column:
    """djb2 over the UTF-8 bytes, 32 bits."""
    return F.when(text == "", F.lit(5381)).otherwise(F.aggregate(_bytes(text), F.lit(5381).cast("bigint"), lambda h, b: (h * 33 + b).bitwiseAND(F.lit(4294967295))))
