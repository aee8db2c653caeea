import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.001"


def test_stages_in_order_over_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= set(before) and ids
        if k < 4:
            assert docs.columns == COLUMNS
        docs = docs.cache()
        before = {i: None for i in ids}
    assert docs.count() == len(before) and {"n_tokens", "token_ids"} <= set(docs.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "pii", "byte_bpe"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_awkward_rows_in_every_stage(spark):
    """Null and repeated ids, equal rows, a long text and columns of clashing names, stage by stage on its own input."""
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words), " ".join(f"v{i}" for i in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, near), (1, near), (1, other), (None, near + " x"), (None, None), (None, None), (2, ""), (3, f"intro {item} outro"), (None, f"say {item}"), (4, "mail x@y.de now"), (4, "mail x@y.de now"), (5, "long " * 40_000)]
    frame = spark.createDataFrame([(i, t, None, None, None, 7, "x", 1.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, k int, spans string, score double")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        kept[name] = sorted((-1 if r.doc_id is None else r.doc_id) for r in out.select("doc_id").collect())
        assert name == "byte_bpe" or out.columns == COLUMNS
        assert stage(spark, frame.limit(0), SF).count() == 0
    every = sorted(-1 if i is None else i for i, _ in rows)
    assert kept["toxicity"] == kept["pii"] == kept["byte_bpe"] == every
    assert kept["ngram_jaccard_join"] == [-1, -1, 1, 1, 2, 3, 4, 5]
    assert kept["decontamination"] == [-1, -1, -1, 1, 1, 1, 2, 4, 4, 5]
