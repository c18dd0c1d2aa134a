from quern.llm.subjects import document_areas, sentences, train_areas


def test_sentences_leave_code_out():
    text = "fix(core): The orbit list stops at 3 comets. `x = 1` maps a star.\nfoo(bar);\n```\ncode here is skipped too\n```\n// callers keep the old order stable"
    assert [" ".join(s) for s in sentences(text)] == ["the orbit list stops at comets", "maps star", "callers keep the old order stable"][:1] + ["callers keep the old order stable"]
    assert sentences(None) == sentences("") == []


def test_held_out_accuracy(spark, small):
    examples = spark.read.parquet(f"{small}/subject_examples.parquet")
    held = examples.filter("example_id % 4 = 0")
    model = train_areas(examples.filter("example_id % 4 <> 0"), steps=25)
    got = document_areas(held, model, "example_id").toPandas().sort_values("share").drop_duplicates("example_id", keep="last").set_index("example_id").subject
    want = held.toPandas().set_index("example_id").subject
    assert (got.reindex(want.index) == want).mean() >= 0.85  # a few labels are wrong by design


def test_every_document_has_an_area(spark):
    examples = spark.createDataFrame([("sky", "The telescope shows a comet near the star."), ("sky", "Each galaxy has one telescope and a star."), ("law", "The judge heard the verdict in court."), ("law", "A verdict of the court binds the judge."), (None, "text"), ("law", None)] * 6, "subject string, text string")
    docs = spark.createDataFrame([(1, "The comet passed the telescope and the star."), (2, "The judge read the verdict in court. A comet came near the star."), (3, None), (4, ""), (5, "x = 1;"), (6, "The judge of the court. " * 3000), (None, "The judge.")], "doc_id bigint, text string")
    got = document_areas(docs, train_areas(examples, docs, parts=2, steps=40)).toPandas()
    assert set(got.doc_id) == {1, 2, 3, 4, 5, 6} and not got.duplicated(["doc_id", "subject"]).any()
    assert set(got[got.doc_id == 2].subject) == {"sky", "law"}
    assert set(got[got.doc_id == 1].subject) == {"sky"} and set(got[got.doc_id == 6].subject) == {"law"}
    assert document_areas(docs.limit(0), train_areas(examples, parts=1, steps=2)).count() == 0
