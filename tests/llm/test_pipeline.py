from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quirebase.llm import langid, simhash


def test_stages(spark, sf, odd):
    docs = odd.select("doc_id", "text", "lang", "source", F.col("n_chars"))
    real = spark.read.parquet(f"{sf}/documents.parquet")
    for start in (real, docs.unionByName(real), docs.limit(0)):
        at = start
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, at, sf).cache()
            assert out.columns == start.columns and dict(out.dtypes) == dict(start.dtypes), name
            at = out
        assert (pipeline.STAGES[-1][1](spark, at, sf).count() > 0) == (at.count() > 0)


def test_decisions(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "12 34 !!", "en", "src1", 8), (10**6 + 1, "zq" * 40 + " xk qj wv zx " * 9, None, "src1", 100)], real.schema)  # the second is unlabelled, else it would be training text
    out = pipeline.language(spark, real.unionByName(junk), sf)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in real.collect()}
    kept = {r.doc_id for r in pipeline.near_dedup(spark, real, sf).collect()}
    texts = {}
    for r in real.orderBy("doc_id").collect():
        texts.setdefault(r.text, r.doc_id)
    assert kept <= set(texts.values())


def test_run(spark, sf):
    out = pipeline.run(spark, sf)
    assert out.count() > 0 and out.where("offset + length > 2048").count() == 0


def test_ids_are_stable(spark, odd):
    assert langid.sample(odd) == langid.sample(odd.repartition(5))
    a = {(r.doc_id, r.fp) for r in simhash.fingerprints(odd).collect()}
    assert a == {(r.doc_id, r.fp) for r in simhash.fingerprints(odd.repartition(7)).collect()}


FOREIGN = [
    "Il governo ha annunciato ieri che il nuovo ponte sarà aperto al traffico entro la fine dell'anno, ma molti cittadini restano scettici.",
    "De regering heeft gisteren bekendgemaakt dat de nieuwe brug voor het einde van het jaar wordt geopend, maar veel inwoners twijfelen.",
    "Hallitus ilmoitti eilen, että uusi silta avataan liikenteelle ennen vuoden loppua, mutta monet asukkaat epäilevät asiaa.",
    "Regeringen meddelade i går att den nya bron öppnas för trafik före årets slut, men många invånare tvivlar på det.",
    "Hyvää huomenta kaikille ystäville",
]


def test_foreign_languages_go(spark, sf):
    """Prose of languages without a label goes, short or long, and a language whose label is taken away; labelled documents stay."""
    real = spark.read.parquet(f"{sf}/documents.parquet")
    prose = spark.createDataFrame([(10**6 + i, t, None, "src1", len(t)) for i, t in enumerate(FOREIGN)], real.schema)
    kept = {r.doc_id for r in pipeline.language(spark, real.unionByName(prose), sf).collect()}
    assert kept == {r.doc_id for r in real.collect()}
    without = real.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    kept = {r.doc_id for r in pipeline.language(spark, without, sf).collect()}
    rest, gone = ({r.doc_id for r in real.where(c).collect()} for c in ("lang <> 'de'", "lang = 'de'"))
    assert rest <= kept and len(gone & kept) <= 0.1 * len(gone)


def test_clashing_columns(spark, sf):
    """Further columns with the names that operators use inside: every stage returns them as they came."""
    names = "score _text lang_pred _label label fits phrase_rate _stay stay component id t1 t2 k0 bad _host _lines _good h host cdf rate parts mean size weight copy repetitions _at _source key n none row nth shelved_3".split()
    real = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = real.select("*", *(F.concat(F.lit(n), F.lit("!")).alias(n) for n in names))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.count() > 0 and out.where(" and ".join(f"{n} = '{n}!'" for n in names)).count() == out.count(), name
