"""Hand-written pages, hard pages and rows of conversations."""

import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from prismframe.llm import chat, html_text


def texts(page):
    return [t for _, t, _ in html_text.blocks_of(page)]


def test_broken_markup_does_not_leak():
    assert texts('<p title="abc>hello there</p><p>next</p>') == ["hello there", "next"]
    assert texts("<p title='a > b'>one</p><p class=x>two &amp; three</p>") == ["one", "two & three"]
    assert texts("<html><head><title>t</title><body><p>kept</p>") == ["kept"]
    assert texts("<head><meta charset=x><p>kept</p>") == ["kept"]
    assert texts("<p>a</p><svg/><p>b</p><!-- gone --><script>var x = '<p>no</p>'</script><p>c</p>") == ["a", "b", "c"]


def test_quoted_values_may_hold_angles():
    assert texts('<p>see <a title="a<b" href="x">link</a> text</p>') == ["see link text"]
    assert texts("<img alt='1 < 2'><p>hi</p>") == ["hi"]
    assert texts('<div onclick="if(a<b){x()}">body text</div>') == ["body text"]
    assert texts('<script data-x="<p>">var a = "<p>no</p>"</script><style media=\'<\'>p{}</style><p>yes</p>') == ["yes"]
    assert texts('<p>a</p><noscript><p>shown without scripts</p></noscript><p>1 < 2 and "3" > 2</p>') == ["a", "shown without scripts", '1 < 2 and "3" > 2']


def reference_blocks(page):
    """The texts between block-level tags, by the standard library's parser."""
    out, held, skip = [], [], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "template", "svg", "head"):
                skip.append(tag)
            elif tag == "br":
                held.append(" ")
            elif tag not in html_text._INLINE:
                flush()

        def handle_startendtag(self, tag, attrs):
            if tag == "br":
                held.append(" ")
            elif tag not in html_text._INLINE:
                flush()

        def handle_endtag(self, tag):
            if skip:
                if tag == skip[-1]:
                    skip.pop()
            elif tag not in html_text._INLINE:
                flush()

        def handle_data(self, data):
            if not skip:
                held.append(data)

    def flush():
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    reader = Reader()
    reader.feed(page)
    reader.close()
    flush()
    return out


def test_blocks_of_the_given_pages_by_another_parser(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        assert texts(r["html"] or "") == reference_blocks(r["html"] or ""), r["page_id"]


def test_unclosed_quotes_are_read_in_linear_time():
    began = time.time()
    for page in ('<a "<a\'" ' * 100_000, '<a "\'<a \'" ' * 100_000, '<a "' * 200_000, "<script " * 200_000, "<p title='x" * 100_000):
        html_text.blocks_of(page)
    assert time.time() - began < 20


def test_extract_of_hard_pages(spark):
    long = "<html><body><article>" + "".join(f"<p>Sentence number {k} of a long article that goes on.</p>" for k in range(20_000)) + "</article></body></html>"
    rows = [(1, "u", None, 5), (2, "u", "", 5), (3, "u", long, 5), (4, "u", "<p>one two three four five six seven.</p>", 5), (4, "u", "<p>one two three four five six seven.</p>", 5), (None, None, "<p></p>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = html_text.extract(pages, train_words=200, train_pages=4).collect()
    assert sorted((r["page_id"] or 0) for r in got) == [0, 1, 2, 3, 4, 4]
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[None] == "" and by[3].count("\n") > 15_000
    assert html_text.extract(pages.limit(0), train_words=5).count() == 0


def test_rows_keep_their_roles_and_near_control_strings(spark):
    rows = spark.createDataFrame([(1, 0, "human", "[s> <INST] <s>"), (1, 1, "gpt", None), (1, 2, "assistant", "a\\b</s>"), (None, 0, None, "x")], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chat.records_of_rows(rows)).withColumn("back", chat.read_turns(F.col("formatted"))).collect()
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["back"]] for r in out}
    assert back == {1: [("human", "[s> <INST] <s>"), ("gpt", ""), ("assistant", "a\\b</s>")], None: [("", "x")]}
    assert next(r["formatted"] for r in out if r["conv_id"] == 1).startswith("<s>human[INST][s> <INST] <\\s>[/INST]</s>")


def test_other_fields_and_empty_lists_keep_their_layout(spark):
    records = [
        '{"id":7,"prompt":"p","completion":"c","meta":{"a":1}}', '{"messages":[],"source":"x"}', '{"messages":[{"role":"user","content":"q","name":"n"},{"role":"gpt","content":"r"}],"model":"m"}',
        '{"system":"s","messages":[{"role":"user","content":"q"}],"prompt":"unused"}', '{"data":{"question":"q","answer":"a","n":1},"n":2}', '{"prompt":"p"}', "no json", None, '{"prompt":"[1","completion":"{x"}',
        '{"messages":[{"content":"only"}]}', '{"turns":[]}',
    ]
    got = chat.format_chats(spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, record string")).orderBy("i").collect()
    assert [r["layout"] for r in got] == ["prompt-completion", "messages", "messages", "messages+system", "nested-data", None, None, None, "prompt-completion", None, "turns"]
    said = [None if r["turns"] is None else [(t["role"], t["text"]) for t in r["turns"]] for r in got]
    assert said[0] == [("user", "p"), ("assistant", "c")] and said[1] == [] and said[2] == [("user", "q"), ("assistant", "r")] and said[3] == [("system", "s"), ("user", "q")]
    assert said[8] == [("user", "[1"), ("assistant", "{x")] and said[10] == []


def test_texts_of_more_than_twenty_million_characters(spark):
    rows = spark.sql("select 1L as conv_id, 0L as turn, 'user' as role, 'q' as text union all select 1L, 1L, 'assistant', repeat('ab<s>', 4300000)")
    for out in (chat.format_turn_rows(chat.turns_of_rows(rows)), chat.format_chats(chat.records_of_rows(rows)), chat.format_chats(chat.recorded(chat.turns_of_rows(rows)))):
        one = out.selectExpr("layout", "size(turns) as n", "length(turns[1].text) as said", "loss[0].end - loss[0].start as masked").first()
        assert (one["n"], one["said"], one["masked"]) == (2, 21_500_000, 25_800_000)


def test_repeated_rows_and_an_empty_table_of_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x", 3), (1, 0, "user", "x", 4), (1, None, "system", "y" * 100_000, 3)], "conv_id long, turn long, role string, text string, turns long")
    one = chat.format_turn_rows(chat.turns_of_rows(rows)).first()
    assert [(t["role"], len(t["text"])) for t in one["turns"]] == [("system", 100_000), ("user", 1), ("user", 1)]
    assert chat.format_turn_rows(chat.turns_of_rows(rows.limit(0))).count() == 0


def test_fingerprints_select_the_layout_of_rows_too(spark, monkeypatch):
    """The layout of rows is looked up by their fingerprint, and its projection reads them."""
    rows = spark.createDataFrame([(1, 1, "gpt", "b"), (1, 0, "human", None)], "conv_id long, turn long, role string, text string")
    one = chat.turns_of_rows(rows).first()
    assert (one["layout"], [(t["role"], t["text"]) for t in one["turns"]]) == ("turns", [("human", ""), ("gpt", "b")])
    mine = chat.Layout("rows", ("turns[].role", "turns[].text", "turns[].turn"), "turns", text="text")
    of = chat.canonical_turns
    for layouts, layout, said in ((chat.LAYOUTS[:2], None, None), ((*chat.LAYOUTS, mine), "rows", [("user", ""), ("assistant", "b")])):
        monkeypatch.setattr(chat, "canonical_turns", lambda records, layouts=layouts: of(records, layouts=layouts))
        got = chat.turns_of_rows(rows).first()
        assert (got["layout"], got["turns"] and [(t["role"], t["text"]) for t in got["turns"]]) == (layout, said)


def test_records_may_be_structs(spark):
    df = spark.sql("select i, named_struct('prompt', p, 'completion', c, 'data', named_struct('question', q, 'answer', 'a')) as record from values (0, 'p', 'c', 'q'), (1, null, null, 'q'), (2, 'p', null, 'q') as t(i, p, c, q)")
    json = df.withColumn("record", F.to_json("record"))
    told = lambda rows: [(r["i"], r["fingerprint"], r["layout"], r["turns"]) for r in chat.canonical_turns(rows).orderBy("i").collect()]
    assert told(df) == told(json) and [r[2] for r in told(df)] == ["prompt-completion", "nested-data", "nested-data"]
