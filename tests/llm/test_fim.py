"""Fill-in-middle: block tree against the pattern itself, whole operator against brute force, round trip."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deskflow.llm import fim
from deskflow.llm.common import read_docs
from deskflow.llm.q_corpus import op11_fill_in_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aé漢😀<PSM> \t\n\r\x0b\x0c\x1f\xa0", max_size=80), st.integers(1, 9))
def test_block_tree_finds_every_cut(text, block):
    units, tree = UNIT.findall(text), fim.BlockTree(text.encode(), block)
    assert (tree.units, tree.code_points) == (len(units), len(text))
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert tree.cut(k) == (len(head.encode()), len(head))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10_000), st.text(alphabet="a<PSM> \n漢", max_size=40))
def test_arrange_is_the_contract(doc_id, text):
    n, form, prefix, middle, output = fim.arrange(text.encode(), doc_id, 50, 80, 42, block=3)
    assert (n, form, prefix, middle, output.decode()) == brute(doc_id, text)


def test_documents_and_edges(spark, docs):
    texts = [None, "", " ", "one", " one  two ", "a<P>b", "x <S>", "tail \n", "漢字 かな 😀 é", "<", "P> <", "word " * 50_000,
             "y" * 200_000, "<P", "\x1funit\x1f sep"]
    rows = [(i * 100 + j, t) for i in range(30) for j, t in enumerate(texts)] + [(None, "no id here"), (7, "twice told"), (7, "twice told")]
    df = docs(*rows).withColumn("output", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = fim.transform(df)
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect()))) == sorted(
        repr((i, *brute(i, t or ""))) for i, t in rows)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    back = got.select("doc_id", fim.restore(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(repr, ((r.doc_id, r.t) for r in back))) == sorted(repr((i, t or "")) for i, t in rows)
    assert fim.transform(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = read_docs(spark, sf_dir).collect()
    want = sorted((r.doc_id, *map(str, brute(r.doc_id, r.text or "")[:4]), sha(brute(r.doc_id, r.text or "")[4]), sha(r.text or "")) for r in rows)
    got = op11_fill_in_middle(spark, sf_dir).collect()
    assert want == sorted((r.doc_id, str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output_sha256, r.restored_sha256) for r in got)
