"""The pipeline against its stages done plainly, one after the other."""

import collections
import re

from test_brute_force import brute_contamination, brute_print, brute_quality, brute_spans, components

import corpus_pipeline
from pyspark.sql import functions as F

from quire.llm import mixing

SF = "/root/testdata/sf0.001"
SYMBOL_RULES = ((10, 1), (10, 3), (1, 1))


def kept_by_quality(rows):
    """No host of this table is bad, so a document may fail one soft rule."""
    kept = []
    for r in rows:
        n, chars, symbols, dup, repeat = brute_quality(r.text)
        lines = len([x for x in r.text.split("\n") if x.split()])
        soft = sum(a * symbols > b * n for a, b in SYMBOL_RULES) + (10 * dup > 3 * lines) + (chars < 2 * n or chars > 15 * n)
        if n >= 50 and 100 * repeat <= 50 * n and soft <= 1:
            kept.append(r)
    return kept


def plain_windows(items):
    windows = collections.defaultdict(set)
    for r in items:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())
        for s in range(max(0, len(words) - 10) + 1):
            windows[tuple(words[s : s + 10])].add(r.item_id)
    return windows


def redacted(text):
    out, at = "", 0
    for start, _, end in brute_spans(text):
        if start >= at:
            out += text[at:start] + "[REDACTED]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = read("documents")
    rows = kept_by_quality(docs.collect())
    prints = {r.doc_id: brute_print(r.text) for r in rows}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if bin(prints[a] ^ prints[b]).count("1") <= 4]
    first = components(pairs, ids)
    rows = [r for r in rows if first[r.doc_id] == r.doc_id]
    windows = plain_windows(read("benchmark").collect())
    by_first = collections.defaultdict(list)
    for w in windows:
        by_first[len(w)].append(w)
    rows = [r for r in rows if not brute_contamination(r.text, windows)[1]]
    expected = {r.doc_id: redacted(r.text) for r in rows}

    found, n_stages = docs, 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, SF)
        assert found.columns == docs.columns
        n_stages += 1
    got = found.collect()
    assert n_stages == 4 and len(got) == len(expected)
    assert {r.doc_id: r.text for r in got} == expected
    assert all(r.n_chars == len(r.text) for r in got if r.text != "" and "[REDACTED]" in r.text)

    plan = {r.doc_id: r.copies for r in mixing.plan_documents(found).collect()}
    mixed = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())
    assert mixed == collections.Counter({d: c for d, c in plan.items() if c})


def test_null_and_shared_ids_with_clashing_columns(spark):
    """Each stage judges rows one by one, whatever their ids, and keeps columns of any name."""
    prose = lambda k: " ".join(f"w{(i * 7919 + k * 104729) % 100003}" for i in range(90))
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 12)
    key = "token = abcdef123456"
    rows = [
        (None, prose(1), "s"), (None, prose(2), None), (None, "too short", "s"), (7, prose(3), "s"), (7, "short too", "s"), (7, f"{prose(4)} {key}", None),
        (9, prose(1), "t"), (None, f"{prose(5)} {item} {prose(6)}", "s"), (7, f"{prose(7)} {item}", "s"), (3, None, "s"), (4, "", None), (5, prose(8), "t"), (5, prose(8), "t"),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("clash") for c in ("row", "k1", "k2", "host", "kept", "words", "of_host", "again", "draw", "copies", "rate", "n_soft", "found")})
    left = [(None, prose(2)), (5, prose(8)), (7, prose(3)), (7, f"{prose(4)} {key}"), (9, prose(1))]
    dropped = [(None, rows[7][1]), (7, rows[8][1])]
    twice = [(5, prose(8)), (None, prose(1))]
    expected = [left + dropped + twice, left + dropped, left, [(i, t.replace(key, "[REDACTED]")) for i, t in left]]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], expected, strict=True):
        docs = stage(spark, docs, SF)
        got = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), name
        assert len(docs.columns) == 18 and docs.where("row <> 'clash' or k1 <> 'clash' or kept <> 'clash'").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    plan = collections.Counter({(r.doc_id, r.size): r.copies for r in mixing.plan_documents(docs).collect() if r.copies})
    assert mixed.columns == docs.columns and sum(plan.values()) == mixed.count() and {r.text for r in mixed.collect()} <= {t for _, t in expected[-1]}
    assert all(stage(spark, docs.where("false"), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
