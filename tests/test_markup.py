import html
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import markup

DOC = """stray <!-- <REUTERS NEWID="9"> --> <REUTERS LEWISSPLIT='TRAIN' NEWID = "1"><TOPICS><D>a &amp; b</D><D> </D><!-- <D>x</D> --><D>
 c  d </D></TOPICS><PLACES></PLACES><TEXT>&#2;<TITLE>T <!-- no --> &lt;1&gt;</TITLE><BODY>b &lt;REUTERS&gt;</BODY></TEXT></REUTERS>
<REUTERS NEWID="2"><TOPICS><D>lost</D>
<reuters newid="3" a="x>y"><topics><d>&eacute;&#xE9;</d></topics></reuters></reuters><REUTERS NEWID="4">"""


def flat(spark, payloads):
    df = spark.createDataFrame([(i, p, "z") for i, p in enumerate(payloads)], "file_id BIGINT, payload STRING, tag STRING")
    got = markup.flat_entries(markup.first_sendings(markup.nodes(df))).distinct().collect()
    return {tuple(r) for r in got}


def test_records(spark):
    assert flat(spark, [DOC, None, ""]) == {
        (1, "reuters", 0, "TRAIN"), (1, "topics", 1, "a & b"), (1, "topics", 2, "c d"), (1, "title", 1, "T <1>"), (3, "reuters", 0, None), (3, "topics", 1, "éé"),
    }


def test_sent_again_counts_once(spark):
    again = '<reuters newid="1" lewissplit="TEST"><topics><d>other</d></topics></reuters>'
    assert {r for r in flat(spark, [DOC, again]) if r[0] == 1 and r[1] == "topics"} == {(1, "topics", 1, "a & b"), (1, "topics", 2, "c d")}


def test_unbalanced_record(spark):
    got = flat(spark, ['<reuters newid="5"><topics><d>a</d><d>b</topics></i><title>t</title></reuters>'])
    assert got == {(5, "reuters", 0, None), (5, "topics", 1, "a"), (5, "topics", 2, "b"), (5, "title", 1, "t")}


def test_links(spark):
    df = spark.createDataFrame([(1, DOC)], "file_id BIGINT, payload STRING")
    rows = [r for r in markup.nodes(df).collect() if r["record_key"] == 1]
    by = {r["node_no"]: r for r in rows}
    for r in rows:
        if r["depth"]:
            assert by[r["parent_no"]]["tag"] == r["parent_tag"] and by[r["parent_no"]]["depth"] == r["depth"] - 1


def test_no_key_and_long_payload(spark):
    long = "<reuters newid='6'><text><title>" + "w " * 300_000 + "</title></text></reuters>"
    got = flat(spark, ["<reuters><title>x</title></reuters>", long])
    assert {(r[0], r[1]) for r in got} == {(6, "reuters"), (6, "title")}


def test_null_file_id(spark):
    df = spark.createDataFrame([(None, DOC)], "file_id BIGINT, payload STRING")
    assert markup.records(markup.first_sendings(markup.nodes(df))).count() == 2


def test_empty_table(spark):
    assert markup.nodes(spark.createDataFrame([], "file_id BIGINT, payload STRING")).count() == 0


def test_long_tag_names(spark):
    """Names that share their first 26 letters are different tags."""
    a, b = "abcdefghijklmnopqrstuvwxyza", "abcdefghijklmnopqrstuvwxyzb" + "c" * 300
    df = spark.createDataFrame([(1, f"<reuters newid='1'><{a}><d>x</d></{a}><{b}><D>y</D></{b}></reuters>")], "file_id BIGINT, payload STRING")
    got = {(r["parent_tag"], r["place"], r["entry"]) for r in markup.nodes(df).where("tag = 'd'").collect()}
    assert got == {(a, 1, "x"), (b, 1, "y")}


def test_quoted_values(spark):
    """Any number of > in a value, either kind of quote, one kind inside the other."""
    many = ">" * 70
    p = f"""<reuters newid="1" x="{many}" lewissplit="A"></reuters><REUTERS NEWID='2' X='a>b' LEWISSPLIT='B'></REUTERS>
<reuters newid="3" x="it's > so" lewissplit='C"'></reuters><reuters newid="4" x = 'say ">"' lewissplit="D"><title>t</title></reuters>
<reuters newid=5 o'clock lewissplit=E><title>u</title></reuters>"""
    got = flat(spark, [p])
    assert {(r[0], r[3]) for r in got if r[1] == "reuters"} == {(1, "A"), (2, "B"), (3, 'C"'), (4, "D"), (5, "E")}
    assert {(r[0], r[3]) for r in got if r[1] == "title"} == {(4, "t"), (5, "u")}


def test_keys(spark):
    """Digits of other scripts are no key; a BIGINT of 19 digits is."""
    p = "".join(f'<reuters newid="{k}" lewissplit="s"></reuters>' for k in ("\u00b2", "9223372036854775807", "9223372036854775808", " 7 ", "x"))
    assert {r[0] for r in flat(spark, [p])} == {9223372036854775807, 7}


def test_self_closed_elements(spark):
    df = spark.createDataFrame([(1, "<reuters newid='1'><br/><a><b><br/></b><br/></a><br/></reuters>")], "file_id BIGINT, payload STRING")
    rows = {r["node_no"]: r for r in markup.nodes(df).collect()}
    assert [(rows[i]["tag"], rows[i]["parent_tag"], rows[i]["depth"]) for i in sorted(rows)] == [
        ("reuters", None, 0), ("br", "reuters", 1), ("a", "reuters", 1), ("b", "a", 2), ("br", "b", 3), ("br", "a", 2), ("br", "reuters", 1),
    ]


def regex_rows(p):
    p, out = re.sub(r"<!--.*?-->", "", p, flags=re.S), set()
    for m in re.finditer(r"(?is)<reuters\b([^>]*)>((?:(?!<reuters\b).)*?)</reuters>", p):
        for b in re.findall(r"(?is)<topics>(.*?)</topics>", m[2]):
            ds = [x for x in (" ".join(html.unescape(d).split()) for d in re.findall(r"(?is)<d>(.*?)</d>", b)) if x]
            out |= {(i + 1, x) for i, x in enumerate(ds)}
    return out


PIECE = st.sampled_from(["<topics>", "</topics>", "<d>a</d>", "<D> b&amp; </D>", "<!-- <d>c</d> -->", "<reuters newid='1'>", "text", "<d></d>", "é"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=4), max_size=4))
def test_lists_like_regex(parts):
    p = "".join("<reuters newid='1'><topics>" + "".join(x for x in xs if "topics" not in x) + "</topics></reuters>" for xs in parts)
    rows = markup.parse_payload(p, "reuters", "newid", "lewissplit", frozenset({"d"}))
    assert {(r[7], r[8]) for r in rows if r[4] == "d" and r[5] == "topics" and r[7]} == regex_rows(p)
