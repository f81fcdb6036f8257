"""The pipeline's stages against plain versions, each on its own input, and on odd rows."""

from collections import Counter

import corpus_pipeline
from dustpan.llm import pieces, queries
from dustpan.llm import template_lines as tl
from tests.llm.test_near_copies import brute_components
from tests.llm.test_template_lines import SENTENCE, WHITE, plain_places


def plain_without(text, places):
    """A text less its dropped units, and less short ones between them."""
    if not text or not places:
        return text
    lines = []
    for i, line in enumerate(text.split("\n")):
        parts, at = SENTENCE.split(line), i * tl._LINE
        near = lambda j, steps: any(at + j + k in places for k in steps)
        gone = [at + j in places or (near(j, (-3, -2, -1)) and near(j, (1, 2, 3)) and len(p.translate({ord(c): 32 for c in WHITE}).split()) < tl.SHORT)
                for j, p in enumerate(parts)]
        if not any(at <= p < at + tl._LINE for p in places):
            lines.append(line)
        elif (left := "".join(p for p, g in zip(parts, gone, strict=True) if not g)).strip(WHITE):
            lines.append(left.lstrip(" "))
    return "\n".join(lines)


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.columns, {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "stage")
        tables[name] = docs
        assert docs.columns == columns or name == "encoding"
    rows = {name: table.collect() for name, table in tables.items()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = rows[""], rows["toxicity"]
    assert not Counter(after) - Counter(before)
    rejected = {r["doc_id"] for r in (Counter(before) - Counter(after)).elements()}
    assert all(labels.get(i) != 0 for i in rejected)
    before, after = after, rows["line dedup"]
    places = plain_places([r["text"] for r in before])
    want = [(*tuple(r)[:columns.index("text")], plain_without(r["text"], places.get(r["text"])), *tuple(r)[columns.index("text") + 1:]) for r in before]
    assert Counter(map(tuple, after)) == Counter(want)
    before, after = after, rows["near-dedup"]
    groups = brute_components({r["doc_id"]: r["text"] for r in before})
    assert not Counter(after) - Counter(before)
    assert Counter(groups[r["doc_id"]][1] for r in after) == Counter({c for _, c, _ in groups.values()})
    before, after = after, rows["mixing"]
    assert set(after) <= set(before) and len({r["source"] for r in after}) == len({r["source"] for r in before})
    library = pieces.PieceTable(pieces.read_model(queries.vocabulary_path())).library
    assert Counter(tuple(r)[:len(columns)] for r in rows["encoding"]) == Counter(map(tuple, after))
    for r in rows["encoding"]:
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == library.decode(r["ids"])


def test_stages_take_odd_rows_and_empty_tables(spark, sf_dir, odd, empty):
    for docs in (odd, empty):
        n, columns = docs.count(), docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "stage")
            assert docs.columns == columns or name == "encoding"
            if name in ("toxicity", "line dedup"):
                assert docs.count() == n
        assert (docs.count() > 0) == (n > 0)
