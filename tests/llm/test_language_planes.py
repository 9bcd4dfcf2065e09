"""Letters of every plane count, also where a text has no others."""

from packrow.llm import hdlang


def test_letters_beyond_the_second_plane():
    space = hdlang.Space()
    assert len(space.grams("\U00020000\U00020001 \U00030000")) == 3
    assert len(space.grams("\U0001f600 \U000e0001 \U0010ffff 12")) == 0


def test_text_of_rare_letters_is_identified(spark):
    rows = [(i, "\U00020000\U00020001\U00020002", "zh") for i in range(1, 9)]
    found = hdlang.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in found} == {"zh"} and all(r.score > 0 for r in found)
