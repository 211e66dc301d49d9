"""Pages of keywords, links or product tags, by the perplexity of their word classes under a model of prose.

A text is read as a sequence of classes: each function word is its own class, every other token belongs to a word
class (content word by how often it stood in the words before, number, tag, link, sign). A bigram model of these
classes is trained on the prose of all documents; pieces of text whose perplexity is abnormal are flagged, and a
page is spam if more than half of its characters stand in flagged pieces.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import cut_lineage

# Function words of the five languages of the corpus.
FUNCTION_WORDS = frozenset(
    (
        "the a an and or but of to in on at by for with from as is are was be it its this that these than then so not no if when while since after before "
        "i we you he she they my our your their me us them has have had do does did can will would should which who what how all any more once into "
        "der die das den dem des ein eine einen einem und oder aber von zu im am auf mit für bei aus nach wie ist sind war wird werden wurde es sie er wir man nicht nur sich "
        "le la les un une des du de et ou mais à au aux en dans sur pour par avec sans ce cette ces que qui quoi est sont il elle on ne pas se nous vous plus rien "
        "el los las una y o pero del al con sin por para como se lo su sus es son está fue no que quien muy más casi nada "
        "के का की को में से पर और है हैं था थी नहीं भी यह वह इस उस इसे जो कई हम ने बाद तो ही"
    ).split()
)
_UNITS = frozenset("g kg mg ml l cl oz lb kcal kj gram grams ग्राम g/100g % lbs".split())
_CURRENCY = frozenset("rs inr usd eur gbp mrp @ ₹ $ € £".split())
_TOKEN = re.compile(
    r"(?P<link><[^<>]{1,400}>|https?://\S+|www\.\S+|\[[^\]\n]{0,80}\]\([^)\s]*\)|(?:\b|//)[\w\-]+\.(?:com|net|org|example|in|io|shop)\b[^\s<>\"]*)"
    r"|(?P<tag>(?<!\w)(?:[#@][^\s#@<>,;|]+|(?i:tags?):(?=\S)[^\s<>,;|]+))"
    r"|(?P<number>\d+(?:[.,:/\-]\d+)*%?)"
    r"|(?P<word>[^\W\d_](?:[\wऀ-ॿ‍]|['’\-](?=\w))*)"
    r"|(?P<end>[.!?।…]+)|(?P<line>\n+)|(?P<sign>[^\s\w])"
)
# Signs that prose, ingredient lists and tables have; each but brackets and quotes is its own class.
_OWN_SIGNS, _QUOTES = ",;:-/|•&", "\"'“”‘’«»„"
BACK = 50
_START = "<s>"


def classes_of(text: str) -> list[tuple[str, int, int]]:
    """(class, first, past last character) of each token; classes don't depend on anything outside the text."""
    found: list[tuple[str, int, int]] = []
    before: deque[str] = deque()
    near: Counter[str] = Counter()
    depth = since = 0
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            low = m[0].lower()
            if low in FUNCTION_WORDS:
                name = low
            elif low in _UNITS:
                name = "unit"
            elif low in _CURRENCY:
                name = "price"
            elif depth > 0:
                name = "inner"
            else:
                seen = near[low]
                name = f"word{min(seen, 3)}"
                before.append(low)
                near[low] += 1
                if len(before) > BACK:
                    near[before.popleft()] -= 1
        elif kind == "sign":
            depth = max(0, depth + (m[0] in "([{") - (m[0] in ")]}"))
            name = m[0] if m[0] in _OWN_SIGNS else "bracket" if m[0] in "()[]{}" else "quote" if m[0] in _QUOTES else "price" if m[0] in _CURRENCY else "sign"
        elif kind == "tag":
            name = "tag"
        else:
            name = kind or "sign"
            if kind == "line":
                depth = 0
                alone, since = since == 1, 0
                if alone:
                    continue  # a line of one word is a word of a longer text set one per line
        since += kind != "line"
        found.append((name, m.start(), m.end()))
    return found


LEAST, MOST = 12, 28


def pieces_of(tokens: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of LEAST to MOST tokens, ended by a sentence or line end where one comes; a short rest joins the piece before it."""
    piece: list[tuple[str, int, int]] = []
    done: list[list[tuple[str, int, int]]] = []
    for token in tokens:
        piece.append(token)
        if len(piece) >= MOST or (len(piece) >= LEAST and token[0] in ("end", "line")):
            done.append(piece)
            piece = []
    if piece:
        if done and len(piece) < LEAST:
            done[-1] = done[-1] + piece
        else:
            done.append(piece)
    yield from done


# Every class by its number; the start of a piece is a class of its own.
NAMES = (*sorted(FUNCTION_WORDS), "word0", "word1", "word2", "word3", "inner", "number", "unit", "price", "tag", "link", "end", "line", "bracket", "quote", "sign", *_OWN_SIGNS, _START)
NUMBER = {name: i for i, name in enumerate(NAMES)}
_ODD = np.isin(NAMES, ("word2", "word3", "sign"))
_LOUD = np.isin(NAMES, ("tag", "link", "price"))


class Batch:
    """The pieces of a batch of encoded documents, end to end: class codes, codes before them, pieces, their documents."""

    def __init__(self, frame: pd.DataFrame):
        held = [(key, sizes, chars, codes) for key, sizes, chars, codes in zip(frame["doc"], frame["sizes"], frame["chars"], frame["codes"]) if len(sizes)]
        self.codes = np.frombuffer(b"".join(codes for *_, codes in held), np.uint16).astype(np.int64)
        self.sizes = np.concatenate([np.asarray(sizes, np.int64) for _, sizes, _, _ in held] or [np.zeros(0, np.int64)])
        self.chars = np.concatenate([np.asarray(chars, np.int64) for _, _, chars, _ in held] or [np.zeros(0, np.int64)])
        self.docs = np.repeat([key for key, *_ in held], [len(sizes) for _, sizes, _, _ in held])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.before = np.roll(self.codes, 1)
        self.before[self.first] = NUMBER[_START]

    def per_piece(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first) if len(self.first) else np.zeros(0)

    def prose(self) -> np.ndarray:
        """Which pieces are taken for training: few words seen often just before and few signs, one link, tag or price at most."""
        return (self.per_piece(_ODD[self.codes].astype(np.int64)) <= 0.15 * self.sizes) & (self.per_piece(_LOUD[self.codes].astype(np.int64)) <= 1)


class Model:
    """Interpolated bigram model over the classes, from at most len(NAMES) ** 2 counts of pairs of class numbers."""

    def __init__(self, counts: dict[tuple[int, int], int]):
        pairs = np.zeros((len(NAMES), len(NAMES)))
        for (a, b), n in counts.items():
            pairs[a, b] += n
        first, second = pairs.sum(axis=1, keepdims=True), pairs.sum(axis=0)
        kinds = np.count_nonzero(second) + 1
        single = (second + 0.5) / (max(second.sum(), 1) + 0.5 * kinds)
        self.surprise = -np.log(0.8 * np.divide(pairs, first, out=np.zeros_like(pairs), where=first > 0) + 0.2 * single)

    def smoothed(self, batch: Batch) -> np.ndarray:
        """Mean surprise of each piece, averaged with its neighbours' of the same document by size, so that one odd sentence doesn't stand out."""
        whole, size = batch.per_piece(self.surprise[batch.before, batch.codes]), batch.sizes.astype(float)
        same = batch.docs[1:] == batch.docs[:-1]
        total, weight = whole.copy(), size.copy()
        total[1:] += np.where(same, whole[:-1], 0)
        weight[1:] += np.where(same, size[:-1], 0)
        total[:-1] += np.where(same, whole[1:], 0)
        weight[:-1] += np.where(same, size[1:], 0)
        return total / weight


def encode(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, tokens and characters of each piece, and all class codes in two bytes each: texts are read this once."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, value in zip(batch["doc"], batch["text"]):
                pieces = list(pieces_of(classes_of(value))) if value.strip() else []
                codes = np.array([NUMBER[t[0]] for p in pieces for t in p], np.uint16).tobytes()
                rows.append((key, [len(p) for p in pieces], [p[-1][2] - p[0][1] for p in pieces], codes))
            yield pd.DataFrame(rows, columns=["doc", "sizes", "chars", "codes"])

    texts = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    return texts.mapInPandas(read, "doc long, sizes array<int>, chars array<int>, codes binary")


def train(encoded: DataFrame) -> dict[tuple[int, int], int]:
    """Class bigrams of the prose of all documents, counted within each task before they are added up."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.zeros(len(NAMES) ** 2, np.int64)
        for frame in batches:
            batch = Batch(frame)
            kept = np.repeat(batch.prose(), batch.sizes)
            pairs += np.bincount((batch.before * len(NAMES) + batch.codes)[kept], minlength=len(pairs))
        seen = np.flatnonzero(pairs)
        yield pd.DataFrame({"a": seen // len(NAMES), "b": seen % len(NAMES), "n": pairs[seen]})

    counted = encoded.mapInPandas(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return {(r.a, r.b): r.n for r in counted.collect()}  # at most (number of classes) ** 2 rows


def score_pieces(encoded: DataFrame, model: Model) -> DataFrame:
    """doc, chars, surprise of each piece."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            batch = Batch(frame)
            yield pd.DataFrame({"doc": batch.docs.astype(np.int64), "chars": batch.chars, "surprise": model.smoothed(batch)})

    return encoded.mapInPandas(score, "doc long, chars long, surprise double")


def spam_pages(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", deviations: float = 3.5, share: float = 0.5) -> DataFrame:
    """doc_id and the share of its characters that stand in flagged pieces, for pages where it is above ``share``.

    A piece is flagged if its mean surprise, smoothed over its neighbours, is farther than ``deviations`` robust
    standard deviations (from the median absolute deviation over the pieces of all documents) from the median, on
    either side. The model is one table of at most (number of classes) squared counts; texts are read once and never shuffled, only one
    small row per piece is.

    Defined cases: null, empty and blank texts are no spam; a text of one piece is judged by it; of a repeated id
    all rows count together; null ids give no row; without any prose the result is empty; other columns are ignored.
    """
    encoded = cut_lineage(encode(documents, doc, text))
    pieces = cut_lineage(score_pieces(encoded, Model(train(encoded))))
    middle = pieces.agg(F.percentile_approx("surprise", 0.5, 10_000).alias("m")).first()["m"]
    if middle is None:
        return pieces.select(F.col("doc").alias("doc_id"), F.lit(0.0).alias("spam_share")).limit(0)
    spread = pieces.agg(F.percentile_approx(F.abs(F.col("surprise") - middle), 0.5, 10_000).alias("m")).first()["m"]
    reach = deviations * max(1.4826 * spread, 1e-6)
    odd = F.abs(F.col("surprise") - middle) > reach
    shares = pieces.groupBy("doc").agg((F.sum(F.when(odd, F.col("chars")).otherwise(0)) / F.sum("chars")).alias("spam_share"))
    return shares.where(F.col("spam_share") > share).select(F.col("doc").alias("doc_id"), "spam_share")
