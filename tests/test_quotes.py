import unicodedata

from hypothesis import assume, given
from hypothesis import strategies as st

from lodestrata.functions.quotes import Bounds, Flat, align, match


def normalise(text):
    f = Flat(text)
    return f.text, f.start, f.end


TEXT = st.text(st.sampled_from("abAB é́­​“”’–•\n\t-.ﬁ…12"), max_size=60)


def test_typography_and_broken_words():
    text = "He said: “the in-\nforma­tion was  lost” – twice."
    a, b = align(text, '"the information was lost" - twice')
    assert text[a:b] == text[9:-1]
    assert align(text, "He said the") is None
    assert align("one two one two", "one two") is None
    assert align("The long enough quote stands here", "the long enough quote") == (0, 21)
    assert align("text", "") is None


def test_reasons_markers_and_values():
    text = Flat("Report\n- the first item costs 1,204 euros\n* The second item\nthe first item again and the first item")
    assert match(text, "") == "quote_length" and match(text, "a b c", bounds=Bounds(most=2)) == "quote_length"
    assert match(text, "no such words here") == "quote_not_found"
    assert match(text, "the first item") == "quote_not_unique"
    assert match(text, "the first item costs 1,204 euros", "204") == "value_not_in_quote"
    assert match(text, "the first item costs 1,204 euros", "1,204") == (9, 41)
    assert match(text, "the second item") == (44, 59) and "- the" not in text.text and "* The" not in text.text
    assert match(Flat("x cafe\u0301 ﬁne"), "café fine") == (2, 11)


def test_quotes_meet_texts_by_a_key(spark):
    from lodestrata.operators import passages

    docs = spark.createDataFrame([(1, "so it was one two three four five six seven"), (2, "one two three"), (3, "two three four alone"), (4, None), (5, "")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "one two three four five"), (2, "was one"), (3, "nine two three four ten"), (4, "x three y"), (5, ""), (6, None), (7, "o")], "item_id long, quote string")
    met = {(r.doc_id, r.item_id) for r in passages.candidates(docs, quotes, "text", "quote", "doc_id", "item_id").collect()}
    assert met == {(1, 1), (3, 1), (1, 3), (3, 3), (1, 2), (1, 4), (2, 4), (3, 4), (1, 7), (2, 7), (3, 7)}
    assert passages.candidates(docs, quotes.limit(0), "text", "quote", "doc_id", "item_id").count() == 0


def test_no_quote_is_missed(spark):
    """Quotes of all lengths cut anywhere from texts, within words too."""
    import random

    from lodestrata.operators import passages

    r = random.Random(4)
    texts = ["".join(r.choice("ab \t\u00e9") for _ in range(r.randrange(60))) for _ in range(40)]
    quotes = [t[a : a + r.randrange(25)] for t in texts for a in (r.randrange(len(t) + 1), 0)]
    docs, asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(quotes)), "item_id long, quote string")
    met = {(x.doc_id, x.item_id) for x in passages.candidates(docs, asked, "text", "quote", "doc_id", "item_id").collect()}
    assert {(i, k) for i, t in enumerate(texts) for k, q in enumerate(quotes) if q and q in t} <= met


@given(TEXT)
def test_offsets_cover_the_text_in_order(text):
    flat, start, end = normalise(text)
    assert len(flat) == len(start) == len(end)
    assert all(a < b for a, b in zip(start, end)) and start == sorted(start)
    assert "  " not in flat


@given(TEXT, st.integers(0, 60), st.integers(1, 60))
def test_an_aligned_span_reads_as_the_quote(text, at, n):
    quote = text[at : at + n]
    # A mark without its base isn't a quote, and a base without its mark isn't the same letter.
    assume(quote and not any(unicodedata.combining(c) for c in text))
    span = align(text, quote, short=0)
    if span:
        wanted, got = normalise(quote)[0].strip(), normalise(text[slice(*span)])[0].strip()
        assert got.lower()[:1] == wanted.lower()[:1] and wanted[1:] in got + normalise(text)[0]
