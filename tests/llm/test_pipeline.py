"""Every stage of the pipeline against brute force, on tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import re

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

own = np.random.default_rng(12)
WORDS = ["".join(own.choice(list("abcdefghij"), own.integers(3, 9))) for _ in range(500)]
#: Names that operators might use inside.
CLASH = ["row", "pos", "line", "lines", "gone", "kept", "_row", "_kept", "_id", "_key", "c0", "c1", "d0", "text_", "n_words", "n_hit", "hit_items", "toxicity", "toxicity_score", "component_id", "size", "rank", "bucket", "h", "mix_size", "position", "_n", "_s"]


def prose(n):
    return " ".join(own.choice(WORDS, n))


BENCH = [prose(25), prose(12), prose(4), None, ""]
RUN = "\n".join(prose(15) for _ in range(5))
BASE = prose(120)
LONG = prose(60_000)
TEXTS = [
    None, "", " \n\t", "one", prose(60), prose(60) + " moron you idiot " + prose(9), "moron idiot", prose(30) + "\n" + RUN + "\n" + prose(20), RUN, prose(10) + "\n" + RUN,
    BASE, BASE, BASE + " and more", prose(30) + " " + BENCH[0] + " " + prose(90), BENCH[0] + " " + BENCH[1], BENCH[2], LONG, LONG + " x", *[prose(50) for _ in range(10)],
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    labelled = [(1000 + i, prose(20) + (" idiot" if i % 3 == 0 else "") + (" moron" if i % 3 == 0 else "")) for i in range(300)]
    rows = [(i, t, ["en", None][i % 2], [None, "a", "b"][i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[10], (None, BASE, None, None, None), (None, prose(40), "en", "a", 3)]  # repeated rows, rows without an id
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.selectExpr("*", *[f"doc_id * 2 as `{c}`" for c in CLASH]).repartition(4)
    extra = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in labelled], SCHEMA).selectExpr("*", *[f"doc_id * 2 as `{c}`" for c in CLASH])
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, spark.read.parquet(f"{at}/documents.parquet"), extra


def run(spark, name, docs, at):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, at)
    if name != "mixing":
        assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes
    rows = out.collect()
    for r in rows:
        for c in set(CLASH) - {"mix_size"} if name == "mixing" else CLASH:
            assert r[c] == (None if r.doc_id is None else 2 * r.doc_id)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), at).count() == 0
    return rows


def key(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def test_toxicity(spark, tables):
    from filmloom.llm.toxicity import learn

    at, docs, extra = tables
    every = docs.union(extra)
    got = run(spark, "toxicity", every, at)
    rows = every.collect()
    score = learn(every, spark.read.parquet(f"{at}/labels.parquet"))(pa.array([r.text for r in rows], pa.string()))
    assert key(got) == key([r for r, s in zip(rows, score, strict=True) if s < corpus_pipeline.REJECT])
    ids = {r.doc_id for r in got}
    assert not ids & {5, 6} and set(range(5)) | set(range(7, len(TEXTS))) <= ids
    assert len(run(spark, "toxicity", docs, at)) == docs.count()  # no labelled document: nothing is learned, all stay


def test_line_dedup(spark, tables):
    at, docs, _ = tables
    got = run(spark, "line_dedup", docs, at)
    rows, seen, want = docs.collect(), {}, []
    one = {(r.doc_id, r.text) for r in rows}
    for d, (i, t) in enumerate(sorted(one, key=lambda x: (x[0] is None, x[0] or 0, str(x[1])))):
        lines = (t or "").split("\n")
        full = [(k, x.strip(" "), len(x.split())) for k, x in enumerate(lines) if x.split()]
        gone = set()
        for a in range(len(full)):
            for b in range(a + 1, len(full) + 1):
                where = seen.setdefault(tuple(x for _, x, _ in full[a:b]), (d, a))
                if (where[0] < d or where[1] + b - a <= a) and sum(n for *_, n in full[a:b]) >= corpus_pipeline.MIN_WORDS:
                    gone |= {k for k, *_ in full[a:b]}
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t
        if not gone or left.split():
            want += [(i, left)] * sum((r.doc_id, r.text) == (i, t) for r in rows)
    assert key(got) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)


def test_near_duplicates(spark, tables):
    at, docs, _ = tables
    got = run(spark, "ngram_jaccard_join", docs, at)
    rows = docs.collect()
    n = corpus_pipeline.SHINGLE
    sets = {}
    for r in rows:
        w = (r.text or "").lower().split()
        if r.doc_id is not None:
            sets[r.doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                k = len(sets[a] & sets[b])
                if k and 100 * k >= corpus_pipeline.PERCENT * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert key(got) == key([r for r in rows if r.doc_id is None or root[r.doc_id] == r.doc_id])
    assert not {11, 12, 17} & {r.doc_id for r in got}


def test_decontamination(spark, tables):
    at, docs, _ = tables
    got = run(spark, "benchmark_decontamination", docs, at)
    find = lambda t: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t or "")]
    windows = set()
    for t in BENCH:
        w = [x for *_, x in find(t)]
        k = min(corpus_pipeline.WINDOW, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    want = []
    for r in docs.collect():
        w, hit = find(r.text), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(x for *_, x in w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
        if len(hit) > 0.5 * len(w):
            continue
        text, last = "", 0
        for i in sorted(hit):
            if i - 1 not in hit:
                text, last = text + r.text[last : w[i][0]] + " ", None
            if i + 1 not in hit:
                last = w[i][1]
        want.append((r.doc_id, text + r.text[last:] if hit else r.text))
    assert key(got) == sorted(want, key=str)
    assert not {14, 15} & {r.doc_id for r in got} and 13 in {r.doc_id for r in got}


def test_decontamination_has_one_python_worker_a_task(spark, tables):
    at, docs, _ = tables
    plan = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs, at)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_mixing(spark, tables):
    at, docs, _ = tables
    got = run(spark, "mixing", docs, at)
    rows = docs.collect()
    due = [r.mix_position for r in got]
    taken = [x for x in due if x is not None]
    assert due[: len(taken)] == sorted(taken) and set(due[len(taken) :]) <= {None}
    size = lambda r: len((r.text or "").split())
    assert all(r.mix_size == size(r) for r in got)
    names = sorted({r.source for r in rows}, key=lambda x: (x is None, x))
    have = {s: sum(size(r) for r in rows if r.source == s) for s in names}
    # weights 1, 2, 3; what a source cannot take goes to the others
    left, target, open_ = sum(have.values()), {}, set(names)
    while open_:
        share = {s: left * (names.index(s) % 3 + 1) / sum(names.index(x) % 3 + 1 for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * have[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3 * have[s]
            left -= target[s]
        open_ -= full
    for s in names:
        own = [r for r in got if r.source == s]
        assert all(abs(r.mix_target - target[s]) < 1e-6 * max(1, target[s]) for r in own)
        assert abs(sum(r.mix_size for r in own if r.mix_position is not None) - target[s]) <= max(r.mix_size for r in own)
    assert {(r.doc_id, r.text) for r in got} == {(r.doc_id, r.text) for r in rows}


def test_whole_pipeline(spark, tables):
    at, docs, _ = tables
    got = corpus_pipeline.run(spark, at).collect()
    assert got and {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}
