"""The fuzzy stage's sieve of titles: loses no pair that scores, and leaves few others."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bibspark.functions import kernels
from bibspark.operators import candidates, detect, quotient, sieve, verify

from .test_goldens import frame

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(rng, letters=60):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(14)]
    return " ".join(words)[:letters].strip().capitalize()


def edited(rng, title):
    at = rng.randrange(len(title))
    return title[:at] + rng.choice(["", "x", " ", "Th"]) + title[at + rng.randint(0, 12) :]


def test_every_pair_that_scores_is_left_and_few_others():
    rng = random.Random(4)
    plain = [prose(rng) for _ in range(60)]
    long = [prose(rng, rng.randint(61, 260)) for _ in range(15)]
    chars = "活着平凡的世界三体人生围城边上下"
    drawn = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 9))) + rng.choice(["", " II", "(珍藏版)", " ab"]) for _ in range(50)]
    odd = [" ", "  ", "é", "É", "T", "t", "The", "the and", "Ｔhe", "In. In. In.", " In. In.", "a b c", "c b a", "x" * 70, "x" * 69 + "y", "ab" * 40, "𝔘𝔫", "War & Peace", "War and Peace", "\0", "a\0b"]
    titles = [*plain, *long, *drawn, *odd, *(edited(rng, t) for t in [*plain, *long, *plain])]
    made = sieve.formed(pd.Series(titles))
    i, j = sieve.close(made[:90], made[90:], 0.40)
    found = set(zip(i.tolist(), (j + 90).tolist(), strict=True))
    close = {(a, b) for a in range(90) for b in range(90, len(titles)) if max(kernels.title(titles[a], titles[b]), kernels.title(titles[b], titles[a])) >= 0.40}
    assert len(close) > 100 and not close - found
    assert len(found - close) < len(close)
    assert [len(x) for x in sieve.close(made[:0], made, 0.40)] == [0, 0]


@pytest.mark.parametrize("least", [0.2, 0.6, 0.9])
def test_other_bounds_lose_nothing(least):
    rng = random.Random(6)
    titles = [prose(rng, rng.randint(3, 80)) for _ in range(60)]
    titles += [edited(rng, t) for t in titles]
    made = sieve.formed(pd.Series(titles))
    found = set(zip(*(x.tolist() for x in sieve.close(made, made, least)), strict=True))
    assert not {(a, b) for a in range(120) for b in range(120) if kernels.title(titles[a], titles[b]) >= least} - found


def test_subsequences_are_no_shorter_than_they_are():
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcde 活") for _ in range(rng.randint(1, 150))) for _ in range(40)]
    got = sieve.common(texts[:20], texts[20:], *(pd.Series(range(20)).to_numpy() for _ in "ij"))
    for a, b, most in zip(texts[:20], texts[20:], got, strict=True):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [max(p, r) if x != y else d + 1 for x, y, d, p, r in _steps(x, b, row)]
        assert most >= row[-1] and (len(a) > 64 or most == row[-1])


def _steps(x, b, row):
    left = 0
    for k, y in enumerate(b):
        yield x, y, row[k], row[k + 1], left
        left = row[k] + 1 if x == y else max(row[k + 1], left)


def test_candidates_of_prose_are_few(spark):
    """Before, pairs were held against letters in common only, and one in a thousand was left, whose ratio had to be made."""
    rng = random.Random(5)
    titles = [prose(rng) for _ in range(500)]
    titles += [edited(rng, t) for t in titles[:40]]
    rows = [(i, t, "Jane Austen", "", i, 1, "epub") for i, t in enumerate(titles)]
    found = {(r["a_ord"], r["b_ord"]) for r in candidates.fuzzy_pairs(frame(spark, rows)).collect()}
    assert found >= {(i, 500 + i) for i in range(40) if kernels.title(titles[i], titles[500 + i]) >= 0.40}
    close = sum(kernels.title(titles[a], titles[b]) >= 0.40 for a, b in found)
    assert close >= 35 and len(found) < 2 * close, (close, len(found))


def test_titles_of_one_form_are_scored_only_where_authors_leave_it_open(spark, monkeypatch):
    """Titles of stop words have one form; before, each two of them were scored, whatever their authors."""
    rng = random.Random(3)
    titles = ["The the the", "the The the", "The The the", "the the The", "The the", "the the the the"]
    authors = ["余华", "余华 著", "路遥", "路遥远", "鲁迅", "周树人", "Leo Tolstoy", "Leo N Tolstoy", "Alexei Tolstoy", "Jane Austen", "Victor Hugo", ""]
    rows = [(i, rng.choice(titles), rng.choice(authors) if i else "余华", "", 0, rng.choice([0, 100, 900]), "epub") for i in range(90)]
    left = detect.prepared(frame(spark, rows)).cache()
    scored, titles_scored, may_match = [], quotient.titles_scored, verify.may_match
    monkeypatch.setattr(quotient, "titles_scored", lambda pairs: scored.append(pairs.count()) or titles_scored(pairs))
    found = []
    for rule in (may_match, lambda pairs: pairs.withColumn("may_match", F.lit(True))):
        monkeypatch.setattr(verify, "may_match", rule)
        members, similar = detect.run_stage("title_with_author_check", left, detect.MatchConfig())
        found.append(({tuple(r) for r in members.collect()}, {r["bucket"]: round(r["similarity"], 9) for r in similar.collect()}))
    assert found[0] == found[1] and found[0][0]
    assert sum(scored[:2]) < sum(scored[2:]) / 2, scored
