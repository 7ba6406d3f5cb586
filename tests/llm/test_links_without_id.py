from __future__ import annotations

from provenlake.llm import fragment_join


def test_a_row_without_id_bridges_two_documents(spark):
    words = [f"w{k}" for k in range(200)]
    edited = lambda *places: " ".join("x" + w if k in places else w for k, w in enumerate(words))
    few = [(1, edited(30, 60)), (None, edited(30, 60, 90, 120)), (2, edited(30, 60, 90, 120, 150, 170)), (3, "other words than those")]
    many = [(10 + k, " ".join(f"v{j}" + "y" * (j == 7 * k) for j in range(1, 150))) for k in range(12)] + [(None, " ".join(f"v{j}" + "y" * (j == 140) for j in range(1, 150)))]
    df = spark.createDataFrame(few + many, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in fragment_join.jaccard_components(df.where("doc_id IS NOT NULL")).collect()}
    assert got[2] == 2  # not linked without the bridge
    got = sorted((r.doc_id or 0, r.component_id) for r in fragment_join.jaccard_components(df).collect())
    assert got == sorted([(0, 1), (1, 1), (2, 1), (3, 3), (0, 10)] + [(10 + k, 10) for k in range(12)])
    assert sorted(r.doc_id for r in fragment_join.deduplicate(df).collect()) == [1, 3, 10]
