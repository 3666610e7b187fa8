"""Detection of a growing catalogue against full runs."""

import random

from bibspark.operators import detect, increments

from .test_goldens import frame


def result(groups, members):
    by = {}
    for r in members.collect():
        by.setdefault(r["group_id"], []).append(r["ord"])
    return sorted((r["group_id"], r["match_type"], round(r["similarity"], 9), tuple(sorted(by[r["group_id"]]))) for r in groups.collect())


def test_five_increments_equal_full_runs(spark):
    rng = random.Random(12)
    titles = ["活着", "《活着》(珍藏版)", "三体", "三体 典藏版", "War and Peace", "War & Peace", "Pride and Prejudice", "Pride and Prejudices", "人生", "人生的"]
    authors = ["余华", "余华 著", "路遥", "路遥远", "Jane Austen", "J. Austen", "Leo Tolstoy", "Leo N Tolstoy", "", "Éva Kiss", "Eva Maria Kiss"]
    isbns, hashes = ["", "", "9787020089543", "9780306406157", "0306406152"], [0, 5, 7, -3, 1 << 40]
    rows = [(i, rng.choice(titles), rng.choice(authors), rng.choice(isbns) if rng.random() < 0.4 else "", rng.choice(hashes), rng.choice([0, 100, 120, 900]), rng.choice(["epub", "pdf"])) for i in range(80)]
    rng.shuffle(rows)  # new books also come before old ones
    state = increments.begun(frame(spark, rows[:30]))
    kinds = set()
    for k in range(5):
        upto = 30 + 10 * (k + 1)
        state = increments.extended(state, frame(spark, rows[upto - 10 : upto]))
        want = result(*detect.detect(frame(spark, rows[:upto])))
        assert result(*state.groups()) == want
        kinds |= {x[1] for x in want}
    assert kinds >= {"isbn_exact", "title_author_simhash", "fuzzy_match"}, kinds
