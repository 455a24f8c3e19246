from pyspark.sql import functions as F

from brainweave.functions import text, time, vector


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_normalize(spark):
    cases = {
        "a<b>c</b>\n\n\n\nd": "ac\n\nd",
        "x\n \n \ny": "x\n\n\ny",  # blank lines are emptied after newlines were collapsed
        "  a   b\t c  ": "a b c",
        "": "",
    }
    for raw, want in cases.items():
        assert one(spark, text.normalize_markdown(F.col("t")), t=raw) == want


def test_tokens_count_utf16_units(spark):
    assert one(spark, text.estimate_tokens(F.lit("abcde"))) == 2
    assert one(spark, text.estimate_tokens(F.lit("😀😀😀"))) == 2
    assert one(spark, text.estimate_tokens(F.lit(""))) == 0


def test_keywords_terms_and_names(spark):
    assert one(spark, text.keywords(F.lit("Été fête kind of fête; 日本語テスト and MORE words here again once"))) == ["fête", "kind", "日本語テスト", "more", "words", "here"]
    assert text.search_terms("don't stop 日本") == ["dont", "stop"]
    assert one(spark, text.name_tokens(F.lit("Lee, Pak-Hong lee"))) == ["lee", "pak", "hong"]
    assert one(spark, text.name_tokens(F.lit("李白"))) == []


def test_slugs_lists_titles(spark):
    assert one(spark, text.slugify(F.lit("  Hello, World! "))) == "hello-world"
    assert one(spark, text.parse_list(F.lit("A; b,\n ,C"))) == ["a", "b", "c"]
    assert one(spark, text.truncate(F.lit("x" * 201))) == "x" * 199 + "…"
    assert one(spark, text.truncate(F.lit("x" * 200))) == "x" * 200
    assert one(spark, text.session_text(F.lit("T"), F.lit("S"), F.array(F.lit("a"), F.lit("b")))) == "[T]\n\nS\n\n(via a · b)"
    assert one(spark, text.session_text(F.lit(None).cast("string"), F.lit("S"), F.array().cast("array<string>"))) == "S"


def test_commands_feedback_hashtags_signals(spark):
    assert one(spark, text.is_new_note(F.lit("  New NOTE ")))
    assert not one(spark, text.is_new_note(F.lit("new note please")))
    assert one(spark, text.is_feedback(F.lit(" \n#AIfeedback this"))) and not one(spark, text.is_feedback(F.lit("so #aifeedback")))
    assert one(spark, text.first_line_hashtags(F.lit("#One b #two\n#three"))) == ["one", "two"]
    assert one(spark, text.is_signal(F.lit("Done!"), ["done"])) and not one(spark, text.is_signal(F.lit("Done!!"), ["done"]))


def test_addresses_and_scope(spark):
    assert one(spark, text.address_of(F.lit("Ann <Ann@X.example>"))) == "ann@x.example"
    assert one(spark, text.address_of(F.lit("BOB@y.example"))) == "bob@y.example"
    scope = lambda labels, sender, to: one(spark, text.mail_scope(F.array(*map(F.lit, labels)).cast("array<string>"), F.lit(sender), F.array(*map(F.lit, to)).cast("array<string>"), ["fam.example"]))
    assert scope(["Family"], "a@b.example", []) == "family"
    assert scope([], "a@fam.example", []) == "family"
    assert scope([], "a@b.example", ["x@c.example", "Me <me@fam.example>"]) == "family"
    assert scope([], "a@b.example", ["x@c.example"]) == "personal"


def test_spans_are_cut_out(spark):
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("size")), F.struct(F.lit(9).alias("start"), F.lit(2).alias("size")))
    assert one(spark, text.without_spans(F.lit("@bot hi 12xx there"), spans)) == "hi 1x there"
    cut = lambda t, *s: one(spark, text.without_spans(F.lit(t), F.array(*[F.struct(F.lit(a).alias("start"), F.lit(n).alias("size")) for a, n in s])))
    assert cut("hi @bot  there\nyou", (3, 4)) == "hi there you"
    assert cut("😀 @bot é😀x", (3, 4), (9, 2)) == "😀 éx"  # offsets count UTF-16 units
    assert one(spark, text.without_spans(F.lit(" as  it is "), F.lit(None).cast("array<struct<start:int,size:int>>"))) == " as  it is "


def test_signals(spark):
    assert one(spark, text.is_done(F.lit(" /Done. "))) and not one(spark, text.is_done(F.lit("done it")))
    assert one(spark, text.is_cancel(F.lit("Cancel "))) and not one(spark, text.is_cancel(F.lit("cancel!")))


def test_titles_of_suggestions(spark):
    actions = lambda *rows: F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).cast("string").alias("reason")) for k, r in rows])
    title = lambda a, s, t: one(spark, text.suggested_title(a, F.lit(s).cast("string"), F.lit(t)))
    assert title(actions(("task", " "), ("task", None), ("note", "n"), ("task", " Call ")), "s", "t") == "Call"
    assert title(actions(("note", "n")), None, " text ") == "text"
    assert title(actions(("task", "")), " sum ", "t") == "sum"


def test_messages_are_split_before_newlines(spark):
    assert one(spark, text.split_message(F.lit("short"), 10)) == ["short"]
    assert one(spark, text.split_message(F.lit("a" * 7 + "\n" + "b" * 9), 10)) == ["a" * 7, "b" * 9]
    assert one(spark, text.split_message(F.lit("a" * 25), 10)) == ["a" * 10, "a" * 10, "a" * 5]
    assert one(spark, text.split_message(F.lit("a\n" + "b" * 14), 10)) == ["a\n" + "b" * 8, "b" * 6]  # a newline in the first half doesn't count


def test_excerpt(spark):
    assert one(spark, text.excerpt(F.lit("# A heading of some length\nshort\nThis line is long enough to be one."))) == "This line is long enough to be one."
    assert one(spark, text.excerpt(F.lit("word " * 20), 22)) == "word word word word…"
    assert one(spark, text.excerpt(F.lit("tiny"))) is None


def test_times(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    assert not one(spark, time.older_than(at("2024-01-01 00:00:00"), 300, at("2024-01-01 00:05:00")))
    assert one(spark, time.older_than(at("2024-01-01 00:00:00"), 300, at("2024-01-01 00:05:01")))
    assert one(spark, time.seconds_left(at("2024-01-01 00:00:09"), at("2024-01-01 00:00:00"))) == 9
    assert one(spark, time.seconds_left(at("2024-01-01 00:00:00"), at("2024-01-01 00:00:09"))) == 0
    label = lambda due: one(spark, time.due_label(at(due), at("2024-01-02 20:00:00"), "Asia/Hong_Kong"))
    assert [label("2024-01-02 10:00:00"), label("2024-01-02 17:00:00"), label("2024-01-05 00:00:00")] == ["OVERDUE", "TODAY", "2024-01-05"]
    assert one(spark, time.iso_day(F.lit(None).cast("timestamp"))) == "undated"


def test_vectors(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, vector.similarity(arr(1, 0), arr(1, 1), 4)) == 0.7071
    assert one(spark, vector.cosine_distance(arr(0, 0), arr(1, 1))) is None
    assert one(spark, vector.cosine_distance(arr(1), arr(1, 1))) is None
    assert one(spark, vector.parse_literal(F.lit("[1, 2.5,x,NaN]"))) == [1.0, 2.5]
    assert one(spark, vector.parse_literal(F.lit("1,2"))) == []
