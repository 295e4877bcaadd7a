"""The pipeline's stages, each against a plain version on what the stage before it kept."""

from __future__ import annotations

import corpus_pipeline
from codeloom.llm import queries

from . import brute


def write(docs, spark, texts, folder):
    docs.selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) as long) as n_chars").write.parquet(f"{folder}/documents.parquet")
    w = brute.words(texts[145])
    bench = {1: " ".join(w[100:130])}
    spark.createDataFrame(list(bench.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return bench


def test_stages(spark, docs, texts, tmp_path):
    folder = str(tmp_path / "sf")
    bench = write(docs, spark, texts, folder)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [now]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        now = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(now)
    rows = [{r["doc_id"]: r for r in s.collect()} for s in seen]
    plain = [{i: r["text"] for i, r in x.items()} for x in rows]
    assert {146, 147, 148, 149}.isdisjoint(plain[1]) and set(range(130)) <= set(plain[1])
    left = brute.lines_left(plain[1])
    changed = {i for i, own in left.items() if len(own) < len(plain[1][i].split("\n"))}
    want = {i: "\n".join(own) for i, own in left.items()}
    assert plain[2] == {i: t for i, t in want.items() if i not in changed or brute.words(t)}
    assert any(not brute.words(t) for t in want.values())  # copies lose all their lines, and go
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2].values())
    assert set(plain[3]) == {i for i, (_, root) in brute.near(plain[2], 5, 80).items() if root == i}
    assert set(plain[4]) == {i for i, v in brute.contamination(plain[3], bench).items() if not v[4]}
    copies = {}
    for r in seen[5].collect():
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 2 for c in copies.values())
    assert set(copies) <= set(plain[4])
    assert all(brute.words(plain[4][i]) for i in copies)


def test_run_is_the_registered_query(spark, docs, texts, tmp_path):
    folder = str(tmp_path / "sf")
    write(docs, spark, texts, folder)
    one = sorted(map(str, queries.QUERIES["pipeline"](spark, folder).collect()))
    assert one and one == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))


def test_stages_on_odd_tables(spark, odd, none, tmp_path):
    """Repeated and null ids, null and empty texts, columns with clashing names: each stage gives what its docstring says."""
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(1, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (None, "ü")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    clash = odd.selectExpr("*", "0L as n_chars", "5 as n_lines", "6 as n_dropped", "7 as Copy", "8 as __id", "9 as h1", "10 as size")
    texts = lambda df: sorted((r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, folder)
        found[name] = texts(out)
        last = name == corpus_pipeline.STAGES[-1][0]
        assert out.columns == [*clash.columns, "_copy"] if last else out.columns == clash.columns, name
        assert stage(spark, none.selectExpr("*", "0L as n_chars"), folder).collect() == [], name
    body, rows = " ".join(f"w{i}" for i in range(50)), [r["text"] for r in odd.collect()]
    assert [t for _, t in found["language ID"]].count("") == 0 and len(found["language ID"]) == 6
    # the smallest id keeps the line, in both of its rows; the empty texts stay, those that lost their only lines go
    assert [t for _, t in found["line dedup"]].count(body) == 2 and [t for _, t in found["line dedup"]].count("") == 2 and len(found["line dedup"]) == 6
    assert len(found["MinHash near-dedup"]) <= len(rows) and "other text under the same id" in [t for _, t in found["MinHash near-dedup"]]
    assert {t for _, t in found["benchmark decontamination"]} == {"", "other text under the same id", "üüü"}
    assert "" not in [t for _, t in found["mixing to target weights"]] and found["mixing to target weights"]


def test_run_leaves_one_folder(spark, docs, texts, tmp_path):
    import os

    folder = str(tmp_path / "sf")
    write(docs, spark, texts, folder)
    rows = corpus_pipeline.run(spark, folder)
    (read,) = {os.path.dirname(f).removeprefix("file://") for f in rows.inputFiles() if "corpus-" in f}
    kept = [f for f in os.listdir(os.path.dirname(read)) if f.startswith("corpus-")]
    before = set(kept)
    corpus_pipeline.run(spark, folder)
    assert len({f for f in os.listdir(os.path.dirname(read)) if f.startswith("corpus-")} - before) == 1
