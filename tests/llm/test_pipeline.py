import collections
import re

import corpus_pipeline as pipeline


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, out = docs.columns, []
    for i, (name, step) in enumerate(pipeline.STAGES):
        step(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        out.append(docs)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == names
    clean, single, cut, mix, pieces = out
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    assert ids(single) <= ids(clean) and ids(cut) == ids(single) and ids(mix) <= ids(cut)
    good = ids(labels.where("toxic = 0"))
    assert len(good - ids(clean)) <= 0.03 * len(good)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert len(set(r.text for r in single.collect())) == single.count()
    # no 200-byte string is left that the stage's input had twice
    seen = collections.Counter()
    for r in single.collect():
        b = r.text.encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    for r in single.collect():
        b = r.text.encode()
        if not any(seen[b[i : i + 200]] > 1 for i in range(len(b) - 199)):
            assert texts[r.doc_id] == r.text
    for r in mix.collect():
        assert texts[r.doc_id] == r.text or texts[r.doc_id].split()[: len(r.text.split())] == r.text.split()
    assert sum(1 for r in pieces.collect() if r.start == 0) == mix.count()
    assert max(collections.Counter(r.doc_id for r in mix.collect()).values()) <= 3
    whole = pipeline.run(spark, sf_dir)
    key = lambda d: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in d.collect())
    assert key(whole) == key(pieces)
    assert all(re.fullmatch(r"\w+", n) for n, _ in pipeline.STAGES)


def test_odd_rows(spark, docs, corpus, nothing, tmp_path):
    """Nulls, blanks, ties, repeated rows, a long text and columns with clashing names, in each stage."""
    spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(10, 60)] + [(None, 1), (11, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "", str(r.lang), str(r.source))
    for name, step in pipeline.STAGES:
        rows = step(spark, docs, str(tmp_path)).collect()
        again = step(spark, docs.repartition(7), str(tmp_path)).collect()
        if name == "sequences":
            assert sum(r.start == 0 for r in rows) == len(corpus)
            continue
        assert rows[0].__fields__ == pipeline.COLUMNS and sorted(map(key, rows)) == sorted(map(key, again))
        ids = collections.Counter(r.doc_id for r in rows)
        if name == "repeated_passages":
            assert ids == collections.Counter(r[0] for r in corpus) and all(r.text is not None for r in rows)
        if name == "near_duplicates":
            assert sum(not (r.text or "").split() for r in rows) == 1 and set(ids.values()) == {1}
        if name == "mixture":
            assert all(r.text.split() and r.n_chars == len(r.text) for r in rows)
            sizes, taken = collections.Counter(), collections.Counter()
            for r in corpus:
                sizes[r[3]] += len((r[1] or "").split())
            for r in rows:
                taken[r.source] += len(r.text.split())
            assert abs(sum(taken.values()) - sum(sizes.values())) <= len(sizes)


def test_empty_stages(spark, nothing, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, step in pipeline.STAGES:
        assert step(spark, nothing, str(tmp_path)).collect() == []
