from pyspark.sql import functions as F

from curricle.functions import fragments as fr
from curricle.functions import text as tx
from curricle.functions.plugins import register_tokenizer
from curricle.functions.tokens import term_counts, tokenize, tokenize_keywords


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn("t").alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, "The GPT-4 model and 수업 데이터 a 2024", tokenize) == ["gpt4", "model", "데이터", "2024"]
    assert one(spark, "다음 2024 데이터", tokenize_keywords) == ["데이터"]


def test_computed_argument_gives_the_same_tokens(spark):
    frame = spark.createDataFrame([("Deep Learning",)], "t string")
    row = frame.select(tokenize(F.concat("t", F.lit(" of Trees"))).alias("x")).first()
    assert row["x"] == ["deep", "learning", "trees"]


def test_term_counts(spark):
    frame = spark.createDataFrame([(["b", "a", "b", "c", "a", "b"],), ([],)], "t array<string>")
    rows = [[(x["term"], x["n"]) for x in r["x"]] for r in frame.select(term_counts("t").alias("x")).collect()]
    assert rows == [[("a", 2), ("b", 3), ("c", 1)], []]


def test_whitespace_of_all_kinds(spark):
    assert one(spark, " a 　b\x1f\n c ", tx.normalize_text) == "a b c"


def test_captions(spark):
    assert one(spark, "[Music] [음악]", tx.clean_speech) == ""
    assert one(spark, "so [applause] entropy", tx.clean_speech) == "so entropy"


def test_titles(spark):
    assert one(spark, "youtube abcdefghijk", tx.speech_title) == ""
    assert one(spark, "[3-2] Decision Tree", tx.speech_title) == "Decision Tree"
    assert one(spark, "Course [12 - 2] x", tx.source_chapter_index) == 12
    assert one(spark, "Chapter 4: Trees", tx.section_chapter_index) == 4


def test_weight_metrics(spark):
    cases = {
        "통계 30% 3강": (30.0, "percent"),
        "통계 총 4강": (4.0, "lecture_count"),
        "2~5주차 통계": (4.0, "weeks"),
        "3 weeks": (3.0, "weeks"),
        "5시간": (5.0, "hours"),
        "2일": (2.0, "days"),
        "3강의실": (None, "none"),
    }
    for line, want in cases.items():
        got = one(spark, line, tx.weight_metric)
        assert (got["value"], got["source"]) == want, line


def test_scores_and_questions(spark):
    assert [one(spark, v, tx.parse_score) for v in ("4점", "4.5", "4d", "NaN", "0", "6")] == [4.0, 4.5, None, None, None, None]
    got = one(spark, "강의 / BQ2-1. 자료는 충분했다", tx.question_parts)
    assert (got["id"], got["grp"], got["label"]) == ("BQ2-1", "BQ2", "자료는 충분했다")


def test_urls(spark):
    assert one(spark, "https://www.youtube.com/playlist?list=PL1", tx.is_playlist_url) is True
    assert one(spark, "https://www.youtube.com/watch?v=a&list=PL1", tx.is_playlist_url) is False
    assert one(spark, "https://youtu.be/abc/x", tx.video_id) == "abc"
    assert one(spark, "https://example.org/watch?v=a", tx.is_video_url) is False


def test_fragments(spark):
    title = "Chapter 3: Support Vector Machine SVM · 총 4강"
    assert one(spark, title, lambda c: fr.fragment_terms(c, "material")) == ["support vector machine svm", "support vector machine", "svm"]
    assert one(spark, "Decision Trees / Introduction", lambda c: fr.fragment_terms(c, "speech")) == [
        "decision tree", "decision trees",
    ]
    assert one(spark, "Motivations and Basics", lambda c: fr.fragment_key(c, "material")) == ""


def test_sql_table_function_matches_the_column_function(spark):
    from curricle.functions.plugins import register_fragment_terms

    register_fragment_terms(spark, "terms_of")
    rows = spark.sql("SELECT * FROM terms_of('Random Forest / Autoencoder', 'material')").collect()
    assert [r["term"] for r in sorted(rows)] == ["random forest autoencoder", "random forest", "autoencoder"]


def test_tokenizer_plugin(spark):
    def letters(batches):
        for batch in batches:
            yield batch.map(list)

    tokenizer = register_tokenizer(spark, letters)
    assert one(spark, "ab", tokenizer) == ["a", "b"]


def test_tokenizer_batches_are_bounded_by_their_characters(spark):
    def sizes(batches):
        for batch in batches:
            total = int(batch.str.len().fillna(0).sum())
            yield batch.map(lambda text: [str(total), text or ""])

    tokenizer = register_tokenizer(spark, sizes, max_chars=100)
    texts = ["x" * 30] * 40 + [None, "", "y" * 500, "z"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", tokenizer("t").alias("t")).collect()
    assert [r["t"][1] for r in sorted(got)] == [t or "" for t in texts]
    assert max(int(r["t"][0]) for r in got) <= 100 + 500


def test_value_facts_follow_the_single_rules(spark):
    from curricle.functions import text as tx

    values = ["", " \t ", "3", " 4.5점", "5.0e0", "7", "-", "12/3 %", "abc", "abcd", "가나다라", "a1b2", "12345678", "1234567x", "좋아요 매우", "x" * 50, "1 " * 40 + "점", None]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    rows = frame.select(
        tx.value_facts("v").alias("f"), (tx.normalize_text("v") == "").alias("blank"), tx.is_numeric_like("v").alias("n"), tx.is_text_rich("v").alias("r"), tx.parse_score("v").alias("s")
    ).collect()
    for r in rows:
        assert tuple(r["f"]) == (r["blank"], r["n"], r["r"], r["s"])
