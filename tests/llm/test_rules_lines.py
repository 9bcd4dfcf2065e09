"""Stock phrases count in lines of any length."""

from packrow.llm import crf


def test_stock_phrases_of_long_lines():
    footer = "Copyright 2020, all rights reserved. Read our privacy policy and the terms of use before you subscribe. " * 6
    prose = "the baker put one cookie on the table and went away to look for more flour " + "in the old mill by the river " * 100
    spaceless = "\u4e00" * 200 + "cookie"
    assert min(map(len, (footer, prose, spaceless.encode()))) >= 400
    assert [crf.read(x).features[0, -1] for x in (footer, spaceless, "accept cookies", "no such words")] == [1, 1, 1, 0]
    assert 0 < crf.read(prose).features[0, -1] < 0.1
