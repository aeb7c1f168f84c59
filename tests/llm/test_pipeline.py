import random
import re

import corpus_pipeline
from nearway.llm import minhash_dedup, mixing, packing, secrets
from nearway.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    r = random.Random(9)
    syllables = {"en": ["the", "ing", "tion", "sh"], "fr": ["une", "eau", "é", "oir"]}
    text = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(2, 4))) for _ in range(n))
    rows = []
    for i in range(160):
        lang = r.choice(["en", "fr"])
        t = text(lang, r.randint(20, 90))
        if i % 10 == 0:
            t += " token = \"" + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"'
        rows.append((i, t, lang, r.choice(["a", "b", "hot", "hot", None])))
    rows += [(500, rows[3][1], "en", "a"), (501, rows[3][1] + " more", "en", "b"), (502, "123 456", "en", "a"), (503, None, "en", "a"), (504, "", None, "a"), (None, "some text here", "en", "a"), (3, rows[3][1], rows[3][2], "a")]
    return spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], SCHEMA)


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    df = documents(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    told = corpus_pipeline.known_language(spark, df, str(tmp_path)).cache()
    ids = {x["doc_id"] for x in told.collect()}
    assert told.columns == df.columns and not ids & {502, 503, 504} and ids >= set(range(160)) | {500, 501, None}
    distinct = corpus_pipeline.distinct_texts(spark, told, str(tmp_path)).cache()
    classes = {x["class_id"] for x in minhash_dedup.near_duplicates(told).collect()}
    assert sorted(x["doc_id"] or -1 for x in distinct.collect()) == sorted(c or -1 for c in classes) and 500 not in classes and 501 not in classes and 3 in classes
    clean = corpus_pipeline.without_secrets(spark, distinct, str(tmp_path)).cache()
    assert clean.count() == distinct.count() and clean.schema == distinct.schema and clean.where(clean.text.rlike("[0-9a-f]{24}")).isEmpty()
    assert secrets.report(clean).where("n_hex > 0 or n_access > 0").isEmpty()
    mixed = corpus_pipeline.mixed_sources(spark, clean, str(tmp_path)).cache()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert sum(words(x["text"]) for x in mixed.collect()) == sum(x["taken"] for x in mixing.mix_sources(clean).collect())
    packed = corpus_pipeline.packed(spark, mixed, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got.columns == packed.columns
    assert sorted(map(repr, map(tuple, got.select(*key).collect()))) == sorted(map(repr, map(tuple, packing.pack(mixed, tokenizer_path()).select(*key).collect())))
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_table(spark, tmp_path):
    df = documents(spark).limit(0)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        assert made.count() == 0, name
        if name != "packing":
            assert made.columns == df.columns
            made.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert all(stage.__doc__ for _, stage in corpus_pipeline.STAGES)
