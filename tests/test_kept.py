"""Kept results against a full recount after every batch."""

import os
import random

from tessera.plans import kept

SCHEMA = "doc_id long, status string, category_slug string, slug string, published_at long"


def recount(articles):
    counts, lists = {}, {}
    for k, (status, category, slug, at) in articles.items():
        counts[status, category] = counts.get((status, category), 0) + 1
        if status == "published":
            for tag in {kept.HOME} | ({category} if category else set()):
                lists.setdefault(tag, []).append((at, k, slug))
    return counts, {tag: [k for _, k, _ in sorted(rows, reverse=True)[: kept.TOP]] for tag, rows in lists.items()}


def test_kept_results(spark, tmp_path, monkeypatch):
    """Articles that come, change status, category, slug or time, ties, null categories, lists that empty and fill: equal to a recount after every batch; untouched tags have no new files."""
    monkeypatch.setattr(kept, "TOP", 3)
    monkeypatch.setattr(kept, "STORED", 6)
    rng = random.Random(9)
    article = lambda k, quiet=False: (rng.choice(["published", "published", "draft", "failed_validation"]), rng.choice(["a", "b", None] if quiet else ["a", "b", "c", "d", None]), f"s{k}-{rng.randrange(3)}", rng.randrange(40))
    table = {k: article(k) for k in range(60)}
    frame = lambda rows: spark.createDataFrame([(k, *v) for k, v in rows.items()], SCHEMA)
    results = kept.Kept(spark, str(tmp_path / "kept"))
    results.start(frame(table))
    anew, quiet = [], 0
    for version in range(1, 8):
        batch = {k: article(k, version % 2 == 0) for k in rng.sample(range(110), 12)}
        if version == 3:  # home's newest go, and all of a
            batch |= {k: ("draft", c, s, at) for k, (st, c, s, at) in table.items() if c == "a" or at > 25}
        if version == 5:
            batch = {k: table[k] for k in list(table)[:5]}  # nothing changes
        before, after = frame(table), frame(table | batch)
        anew += results.apply(version, kept.changes(before, frame(batch)), after)
        table |= batch
        counts, lists = recount(table)
        assert {(r["status"], r["category_slug"]): r["n"] for r in results.counts(version).collect()} == counts
        got = {}
        for r in sorted(results.lists(version).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["tag"], []).append(r["doc_id"])
        assert got == lists
        folder = tmp_path / "kept" / "lists" / f"version={version}"
        written = {name.removeprefix("tag=") for name in os.listdir(folder) if name.startswith("tag=")}
        assert version != 5 or not written
        quiet += not {"c", "d"} <= written
    assert anew and quiet > 1


def test_counts_are_signed_sums(spark):
    before = spark.createDataFrame([(1, "draft", "a", "s", 1), (2, "published", "a", "t", 2)], SCHEMA)
    batch = spark.createDataFrame([(1, "published", "a", "s", 1), (2, "published", "a", "t", 2), (3, "draft", None, "u", 3)], SCHEMA)
    assert {tuple(r) for r in kept.deltas(kept.changes(before, batch)).collect()} == {("draft", "a", -1), ("published", "a", 1), ("draft", None, 1)}
    assert {r["tag"] for r in kept.touched(kept.changes(before, batch)).collect()} == {"home", "a"}
