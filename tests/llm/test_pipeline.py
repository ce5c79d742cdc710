"""Each stage of the pipeline on what its predecessor kept, against plain restatements."""

import corpus_pipeline as pipeline
import test_operators as plain
from weftline.llm import decontam, packing, quality
from weftline.llm.common import stored
from weftline.llm.queries import table, tokenizer_file

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, kept = table(spark, SF, "documents"), []
    for name, stage in pipeline.STAGES:
        kept.append(docs.collect())
        docs = stored(stage(spark, docs, SF), name)
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    start, good, lined, single, clean = kept

    scores = quality.scored(table(spark, SF, "documents"), table(spark, SF, "labels")).select("doc_id", "score").collect()
    assert {r.doc_id for r in good} == {i for i, s in scores if s >= 0.3} and 0 < len(good) <= len(start)

    removed = plain.plain_lines([(r.doc_id, r.text) for r in good])
    expected = {r.doc_id: "\n".join(x for p, x in enumerate(r.text.split("\n")) if p not in removed[r.doc_id]) for r in good}
    assert {r.doc_id: r.text for r in lined} == expected and all(r.n_chars == len(r.text) for r in lined)

    s = plain.sets([(r.doc_id, r.text) for r in lined], 5)
    ids = {r.doc_id for r in single}
    linked = lambda i, j: s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])
    assert all(any(linked(i, j) for j in s if j != i) for i in s if i not in ids)
    assert not any(linked(i, j) for i in ids for j in ids if i < j)

    items = {str(r.item_id): r.text for r in table(spark, SF, "benchmark").collect()}
    assert {r.doc_id for r in clean} == {r.doc_id for r in single if plain.plain_hits(r.text, items)[1] == 0}

    tokens = packing.Tokens(tokenizer_file())
    rows = docs.collect()
    lengths = {r.doc_id: len(tokens.ids(r.text)) // 4 + 1 for r in clean}
    assert {(r.doc_id, r.piece): (r.start, r.length) for r in rows} == {(i, p): x for i, n in lengths.items() for p, x in enumerate(packing.pieces_of(n, 2048))}
    assert {r.doc_id for r in pipeline.run(spark, SF).select("doc_id").distinct().collect()} == set(lengths)


def test_contaminated_rows_without_id_go(spark):
    item = max((r.text for r in table(spark, SF, "benchmark").collect() if r.text), key=len)
    rows = [(None, f"before {item} after"), (None, "nothing of it"), (None, None), (1, item), (2, "nothing of it"), (None, "nothing of it"), (None, item)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], table(spark, SF, "documents").schema)
    left = pipeline.benchmark_decontamination(spark, docs.repartition(3), SF)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (0, "nothing of it"), (0, "nothing of it"), (2, "nothing of it")]


def test_stages_without_documents(spark):
    """Every stage of an empty table, and of documents without text or id, gives its columns and keeps what it may not remove."""
    docs = table(spark, SF, "documents")
    for name, stage in pipeline.STAGES:
        none = stage(spark, docs.where("false"), SF)
        assert none.collect() == [] and (name == "best_fit_packing" or none.columns == docs.columns), name
    bare = spark.createDataFrame([(None, None, "en", "web", 0), (None, "", "en", "web", 0), (5, None, "en", "web", 0), (5, None, "en", "web", 0)], docs.schema)
    for name, stage in pipeline.STAGES[1:4]:
        left = stage(spark, bare, SF)
        assert left.columns == docs.columns, name
        assert sum(r.doc_id is None for r in left.collect()) == 2, name
