"""Language identification as multilingual mixture inference.

A document is a bag of character trigrams, each drawn from one of its languages. Expectation
maximisation estimates the languages' proportions from trigram likelihoods; nested language sets, in
the order of these proportions, are compared by penalised likelihood. The trigram models are counted
on a bounded sample of labelled training rows (SAMPLE rows per language, chosen by a hash of the id);
predictions read whole texts and nothing but the text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Bins of the hashed trigrams. Training rows per language (expected; a documented bound on what the models are counted on).
BINS, SAMPLE = 1 << 14, 3000
FOLDS, HELD_OUT = 4, 2
ROUNDS, SMOOTH, PENALTY = 12, 0.5, 4.0
MOST_LANGUAGES = 512
#: Characters counted at once.
STEP = 1 << 18


def held_out(id_col: str) -> Column:
    """True for ids whose CRC-32 (as text) has the held-out remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


@cache
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter; once per worker."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(sys.maxunicode + 1)), np.uint8).astype(bool)


def trigrams(text: str) -> tuple[np.ndarray, bool]:
    """(counts of hashed trigrams over letters and word gaps, whether there is any letter)."""
    counts, some = np.zeros(BINS, np.int64), False
    low = text.lower()
    for k in range(0, len(low), STEP):
        codes = np.frombuffer((" " * (k == 0) + low[max(k - 2, 0) : k + STEP] + " " * (k + STEP >= len(low))).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        some = some or bool(letter.any())
        codes = np.where(letter, codes, np.uint32(32))
        mixed = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA77)) ^ (codes[2:] * np.uint32(0xC2B2AE3D))
        mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        counts += np.bincount((mixed >> np.uint32(18))[letter[1:-1]], minlength=BINS)
    return counts, some


def mixture(counts: np.ndarray, chance: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """EM over the columns of ``chance`` (trigrams x languages): (chosen languages by proportion, their proportions, proportions of all)."""
    n, size = counts.sum(), chance.shape[1]

    def run(p: np.ndarray, own: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            share = own * p
            p = counts @ (share / share.sum(axis=1, keepdims=True)) / n
        return p

    single = counts @ np.log(chance)
    best = int(np.argmax(single))
    everything = run(np.full(size, 1 / size), chance, ROUNDS)
    order = sorted(range(size), key=lambda i: (-everything[i], i))
    cost = PENALTY * np.log(n + 1)
    chosen, share, top = [best], np.ones(1), single[best]
    if counts @ np.log(chance @ everything) - top <= cost * 0.5:  # no set can gain what one more language costs
        return chosen, share, everything
    for k in range(2, size + 1):
        if everything[order[k - 1]] < 0.01:
            break
        own = chance[:, order[:k]]
        p = run(everything[order[:k]] / everything[order[:k]].sum(), own, ROUNDS // 2)
        value = counts @ np.log(own @ p) - cost * (k - 1)
        if value > top:
            chosen, share, top = order[:k], p, value
    turn = sorted(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
    return [chosen[i] for i in turn], share[turn], everything


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages in order, BINS x languages trigram probabilities) from training rows with a label; at most BINS numbers per language reach the driver."""
    bounded_batches(docs.sparkSession)
    train = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    languages = sorted(r["lang"] for r in known)
    if not languages:
        return [], np.zeros((BINS, 0))
    rate = F.create_map(*(x for r in known for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["n"])))))
    place = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = train.filter(place < F.element_at(rate, F.col("lang"))).select("lang", F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                own = held.setdefault(lang.as_py(), np.zeros(BINS, np.int64))
                own += trigrams(text.as_py())[0]
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "bin", "n"])

    counted = chosen.mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = np.full((BINS, len(languages)), SMOOTH)
    for lang, bins, ns in counted.groupBy("lang").agg(F.collect_list("bin"), F.collect_list("n")).collect():
        table[np.array(bins, np.int64), languages.index(lang)] += ns
    return languages, table / table.sum(axis=0)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (mixture proportion of that language), languages (chosen set, ``lang:share`` joined).

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if no training row has a label. Repeated rows are
    judged alike; columns other than id and text are never read for a prediction.
    """
    languages, table = fit(docs, id_col, text_col, lang_col, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, sets = [], [], []
            for text in batch.column(2):
                own = text.as_py()
                counts, some = trigrams(own) if own and languages else (None, False)
                if not some:
                    names.append("und")
                    scores.append(0.0)
                    sets.append("")
                    continue
                at = np.flatnonzero(counts)
                chosen, share, everything = mixture(counts[at].astype(float), table[at])
                names.append(languages[chosen[0]])
                scores.append(float(min(1.0, everything[chosen[0]])))
                sets.append(",".join(f"{languages[i]}:{p:.3f}" for i, p in zip(chosen, share, strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())], [id_col, "held_out", "lang_pred", "score", "languages"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(id_col, held_out(id_col).alias("held_out"), text_col)
    return own.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, languages string")
