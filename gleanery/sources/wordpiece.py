"""WordPiece: greedy longest-match pieces of a given vocabulary."""

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import ship

UNKNOWN, START, END, PAD, CONTINUED, LONGEST = "[UNK]", "[CLS]", "[SEP]", "[PAD]", "##", 100


def basic_tokens(text: str) -> list[str]:
    """Lower-case words without accents; punctuation and CJK characters stand alone."""
    out, word = [], []
    for c in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(c)
        if kind == "Mn":
            continue
        alone = kind[0] in "PS" or 0x4E00 <= ord(c) <= 0x9FFF or 0x3400 <= ord(c) <= 0x4DBF
        if c.isspace() or kind in ("Cc", "Cf") or alone:
            if word:
                out.append("".join(word))
                word = []
            if alone:
                out.append(c)
        else:
            word.append(c)
    return out + (["".join(word)] if word else [])


def pieces(word: str, vocabulary: dict[str, int]) -> list[str]:
    if len(word) > LONGEST:
        return [UNKNOWN]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            p = (CONTINUED if at else "") + word[at:end]
            if p in vocabulary:
                out.append(p)
                at = end
                break
        else:
            return [UNKNOWN]
    return out


def encode(text: str, vocabulary: dict[str, int], length: int) -> list[int]:
    """Ids with the start and end marks, cut and padded to a length."""
    found = [vocabulary.get(p, vocabulary.get(UNKNOWN, 0)) for w in basic_tokens(text) for p in pieces(w, vocabulary)][: length - 2]
    ids = [vocabulary.get(START, 0), *found, vocabulary.get(END, 0)]
    return ids + [vocabulary.get(PAD, 0)] * (length - len(ids))


def encode_documents(docs: DataFrame, vocabulary: list[str], length: int = 256) -> DataFrame:
    """doc_id, ids of every text; the vocabulary (its order gives the ids) is broadcast."""
    ship(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: encode(t or "", table.value, length))

    return docs.select("doc_id", run("text").alias("ids"))
