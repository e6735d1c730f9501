"""The pipeline's stages against brute force, and on odd rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_operators import ODD, brute_components, brute_hits, check_packing, ids_of, words


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.toPandas()]
    current = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, SF)
        assert current.columns == docs.columns
        kept.append(current.toPandas().sort_values("doc_id", ignore_index=True))
        current = spark.createDataFrame(kept[-1], docs.schema)
    raw, spoken, single, cut, clean = kept
    assert set(spoken.doc_id) == {i for i, t in zip(raw.doc_id, raw.text) if any(c.isalpha() for c in t)}
    expected = brute_components(list(zip(spoken.doc_id, spoken.text)))
    assert set(single.doc_id) == {doc for doc, _, _, keep in expected if keep}
    assert set(cut.doc_id) <= set(single.doc_id)
    assert (cut.n_chars == cut.text.map(len)).all()
    seen = {}
    for doc, text in zip(cut.doc_id, cut.text):
        w = words(text)
        for k in range(len(w) - 49):
            assert seen.setdefault(tuple(w[k : k + 50]), doc) == doc
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    hits = brute_hits(cut.text, list(zip(items.item_id, items.text)))
    assert set(clean.doc_id) == {doc for doc, (_, hit, _) in zip(cut.doc_id, hits) if not hit}
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows, dict(zip(clean.doc_id, ids_of(clean.text))))
    assert {r.doc_id for r in rows} == set(clean.doc_id)


def test_documents_in_no_learned_language_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    letters = np.random.default_rng(1).choice(list("abcdefghijklmnopqrstuvwxyz    "), 600)
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    planted = [(-1, "यह एक हिन्दी वाक्य है और इसमें कुछ शब्द हैं " * 8), (-2, "".join(letters)), (-3, finnish)]
    # Rows without lang are not learned from: every fourth of the table is held out, and has to stay.
    rows = docs.withColumn("lang", F.when(F.col("doc_id") % 4 != 2, F.col("lang")))
    rows = rows.union(spark.createDataFrame([(i, t, None) for i, t in planted], docs.schema))
    left = {r.doc_id for r in corpus_pipeline.identify_language(spark, rows, SF).collect()}
    assert left == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text)}


def test_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, matches string, class string"
    odd = spark.createDataFrame([(i, t, lang, None, len(t or ""), "m", "c") for i, t, lang in ODD], schema)
    for given in (odd, odd.limit(0)):
        current = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, SF)
            assert current.columns == given.columns
        left = [r.doc_id for r in current.collect()]
        assert len([x for x in left if x is not None]) == len({x for x in left if x is not None})
        corpus_pipeline.pack_sequences(spark, current, SF).count()
    one = corpus_pipeline.keep_one_of_each_group(spark, odd, SF).where(F.col("text") == "one").collect()
    assert [r.doc_id for r in one] == [6]
