"""Chat formatting, pseudonyms and the token file: exact round trips."""

import datetime
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deskflow.llm import chat, pii, rangecoder, token_output
from deskflow.llm.common import read_docs
from deskflow.llm.q_corpus import HOSTILE, TOKENIZER
from deskflow.session import scratch_path

TOKENS = token_output.load_tokenizer(TOKENIZER)

PARTS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", " ", "\\", "<<SYS>>", "<</SYS>>", "<<ROLE ", "<</ROLE>>", ">>",
                                  "<", ">", "[", "]", "/", "a", "é", "\n", "ok", "_"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a>>b", "x\\"]), PARTS), max_size=5))
def test_grammar_round_trip(turns):
    rendered = [chat.render_turn(r, t) for r, t in turns]
    whole = chat.BEGIN + "".join(x[0] for x in rendered)
    assert [(r, t) for r, t, *_ in chat.parse_turns(whole, len(chat.BEGIN))] == turns
    assert all(chat.unescape(x[0][x[1]:x[2]]) == t for x, (_, t) in zip(rendered, turns))


def expected(rows):
    convs = {}
    for c, _, role, text in rows:
        s = convs.setdefault(c, [0, "", ""])
        s[0] += 1
        s[1] += f"{role or ''}\n{text or ''}\n"
        s[2] += text or "" if role == "assistant" else ""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {c: (n, sha(t), len(a), sha(a)) for c, (n, t, a) in convs.items()}


def test_chat_edges(spark):
    rows = [(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE), (1, 0, "system", None), (1, 1, "user", ""), (1, 2, "assistant", None),
            (2, 0, "assistant", "one"), (2, 1, "assistant", "two </s>"), (3, 0, None, "no role"), (4, 0, "tool", "x\\"),
            (5, 0, "user", "long " * 50_000), (5, 1, "assistant", "[INST] " * 20_000), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("x"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got == expected(rows)
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []
    twice = chat.read_back(chat.format_turns(df.where("conv_id = 2").union(df.where("conv_id = 2")))).collect()
    assert [r.n_turns for r in twice] == [4]


def test_conversations(spark, sf_dir):
    rows = read_docs(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect()
    got = chat.read_back(chat.format_turns(read_docs(spark, sf_dir, "conversations"))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(
        [(r.conv_id, r.turn, r.role, r.text) for r in rows])


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"k")
    for bound in (1, 2, 10, 97, 1000):
        images = [f.permute(i, bound, "t") for i in range(bound)]
        assert sorted(images) == list(range(bound))
        assert [f.permute(i, bound, "t", inverse=True) for i in images] == list(range(bound))
    assert [f.permute(i, 1000, "t") for i in range(9)] != [pii.Feistel(b"other").permute(i, 1000, "t") for i in range(9)]


VALUES = {"card": "4111 1111 1111 1111", "phone": "+1 (319) 555-5132", "ip": "27.109.211.155", "date": "2024-02-29",
          "national": "123-45-6789", "iban": "DE89 3704 0044 0532 0130 00", "email": "jane.doe7@example.com"}
LEFT = ["4111 1111 1111 1112", "999.1.1.1", "2023-02-29", "000-12-3456", "DE00 3704 0044 0532 0130 00", "version 2.0", "CC BY-NC 4.0",
        "tok 0641917ea4e9feb9cda83477b57ac2654884f485", "a@b"]


@pytest.mark.parametrize("kind", VALUES)
def test_values_keep_their_format_and_come_back(kind):
    f, value = pii.Feistel(b"key"), VALUES[kind]
    text = f"see {value}, or ({value}) é"
    hits = list(pii.find(text, f))
    assert [(k, v) for k, _, v, _ in hits] == [(kind, value)] * 2
    new = hits[0][3]
    assert new == hits[1][3] != value and len(new) == len(value)
    assert "".join("9" if c.isdigit() else "a" if c.isalpha() and kind == "email" else c for c in new) == "".join(
        "9" if c.isdigit() else "a" if c.isalpha() and kind == "email" else c for c in value)
    assert [k for k, *_ in pii.find(new, f)] == [kind]  # the pseudonym is valid again
    assert pii.rewrite(pii.rewrite(text, f), f, inverse=True) == text


@pytest.mark.parametrize("value", ["+1 (017) 555-7713", "(017) 555-7713", "+1 117-055-7713", "+1 (319) 155-5132", "+1 (000) 000-0000"])
def test_marked_phones_need_no_dialled_area(value):
    f = pii.Feistel(b"key")
    text = f"call {value}, not 017-555-7713"
    (kind, start, found, new), = pii.find(text, f)
    assert (kind, start, found) == ("phone", 5, value) and new != value
    assert [c.isdigit() for c in new] == [c.isdigit() for c in value]
    assert pii.rewrite(pii.rewrite(text, f), f, inverse=True) == text


NEIGHBOURS = [("card", "4111 1111 1111 1111", " 123"), ("card", "4111111111111111", " 12"), ("card", "4111-1111-1111-1111", "-123"),
              ("card", "3782 822463 10005", " 7 x"), ("iban", "PL61 1090 1014 0000 0712 1981 2874", " PLN"),
              ("iban", "AT61 1904 3002 3457 3201", " EUR 50"), ("iban", "BE68 5390 0754 7034", " DATE 2024 ABCD"),
              ("date", "2024/05/01", "."), ("date", "2024.05.31", ", 7"), ("date", "12/25/2020", " 3"), ("date", "12-31-1999", ""),
              ("card", "٤١١١ ١١١١ ١١١١ ١١١١", ""), ("date", "٢٠٢٤-٠٢-٢٩", " x")]


@pytest.mark.parametrize("kind, value, after", NEIGHBOURS)
def test_values_beside_others_and_other_date_orders(kind, value, after):
    for key in range(60):
        f = pii.Feistel(b"%d" % key)
        text = f"see {value}{after}"
        hits = list(pii.find(text, f))
        assert [(k, at, v) for k, at, v, _ in hits] == [(kind, 4, value)]
        assert list(map(str.isdecimal, hits[0][3])) == list(map(str.isdecimal, value)) and hits[0][3].isascii() == value.isascii()
        new = pii.rewrite(text, f)
        assert new.endswith(after) and pii.rewrite(new, f, inverse=True) == text
        alone = pii.rewrite(value, f)
        assert alone == hits[0][3]  # the neighbours do not change the pseudonym


def test_long_cards_come_back_in_groups():
    f = pii.Feistel(b"key")
    payloads = [f"62{i * 7919:016d}" for i in range(60)]
    for digits in (p + pii.luhn_digit(p) for p in payloads):
        text = " ".join(digits[i:i + 4] for i in range(0, 19, 4))
        assert pii.rewrite(pii.rewrite(text, f), f, inverse=True) == text


def test_texts_with_digits_of_any_script_are_read(docs):
    got = pii.findings(docs((1, "٢٠٢٤-٠٢-٢٩"), (2, "no value")), b"key").collect()
    assert [(r.doc_id, r.kind) for r in got] == [(1, "date")]


def test_every_date_maps_to_another_date():
    f = pii.Feistel(b"key")
    days = [(datetime.date(1999, 12, 1) + datetime.timedelta(i)).isoformat() for i in range(800)]
    images = [pii.date(d, f, False) for d in days]
    assert len(set(images)) == 800 and [pii.date(d, f, True) for d in images] == days
    assert pii.date("29.02.2024", f, False)[2] == "."


def test_pii_documents(spark, docs):
    df = docs(*[(i, f"text {v} end") for i, v in enumerate(VALUES.values())], *[(100 + i, t) for i, t in enumerate(LEFT)],
              (200, None), (201, ""), (None, VALUES["ip"]), (202, "word " * 100_000 + VALUES["card"]), (0, f"text {VALUES['card']} end"))
    df = df.withColumn("kind", F.lit("x"))
    got = pii.findings(df, b"key").collect()
    assert {r.doc_id for r in got} == {*range(len(VALUES)), None, 202}
    assert len({r.pseudonym for r in got if r.kind == "card"}) == 1  # equal values stay linked
    back = pii.pseudonymize(pii.pseudonymize(df, b"key"), b"key", inverse=True)
    assert back.schema == df.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert pii.findings(df.limit(0), b"key").collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 130, 5000, 60_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (np.minimum(rng.zipf(1.4, n) - 1, 49_407), rng.integers(0, 49_408, n), np.full(n, 7), np.arange(n) % 3):
        ids = ids.astype(np.uint32)
        assert np.array_equal(rangecoder.decode(rangecoder.encode(ids, 49_408)), ids)


def test_coder_learns_and_detects_damage():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 40_000, 50)
    ids = np.tile(phrase, 2000).astype(np.uint32)
    block = rangecoder.encode(ids, 49_408)
    assert len(block) * 8 < 2.5 * len(ids)
    for at in (5, 60, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 16
        with pytest.raises(rangecoder.CorruptBlock):
            rangecoder.decode(bytes(bad))
    with pytest.raises(ValueError):
        rangecoder.encode(np.array([9]), 9)


def check_file(spark, df, block_tokens=4096):
    path = scratch_path(spark, "test-tokens")
    token_output.write_tokens(df, path, TOKENIZER, block_tokens=block_tokens)
    got = sorted(token_output.read_tokens(spark, path).collect(), key=lambda r: r.start)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    tokenizer = token_output.load_tokenizer(TOKENIZER)
    ids = {t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t in rows}
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (str(i), len(ids[t]), zlib.crc32(ids[t].tobytes())) for i, t in rows)
    whole = {r.doc_id: r.ids for r in token_output.read_ids(spark, path).collect()}
    assert all(whole[i] in [ids[t].tolist() for j, t in rows if j == i] for i, _ in rows)


def test_token_file(spark, docs, sf_dir):
    check_file(spark, read_docs(spark, sf_dir))
    check_file(spark, docs((5, "Some Text's here, it's <|endoftext|> ok"), (3, None), (3, ""), (9, "á á ÅSTRÖM 12.5"),
                           (None, "no id"), (4, "same"), (4, "same"), (4, "other"), (1, "long " * 30_000), (2, "x\x0by\x1cz\x85q w"))
               .withColumn("part", F.lit(1)))


def test_empty_token_file(spark, docs):
    path = scratch_path(spark, "test-tokens")
    token_output.write_tokens(docs((1, "a")).limit(0), path, TOKENIZER)
    assert token_output.read_tokens(spark, path).collect() == []


def test_pieces_give_the_tokenizers_ids():
    tokenizer = token_output.load_tokenizer(TOKENIZER)
    texts = ["", " lead", "Don't WE'LL they've", "tab\tand\nline", "<|startoftext|>x <|endoftext|>", "naïve café", "a\x00b"]
    ids, sizes = token_output.token_ids(tokenizer, pa.array(texts))
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


ODD = st.text(st.sampled_from("abZé'ÀİIß.,<|>12²x\u0301\u00a0 \n…s-_“ЖKſªµ"), max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(ODD | st.sampled_from([None, "it's I'LL x<|endoftext|>y", "don't a.'s", "É'S"]), max_size=12), st.sampled_from([0, 3, 1000]))
def test_runs_tokenized_once_give_the_ids_of_whole_texts(texts, most):
    tokenizer = TOKENS
    known = token_output.Known(tokenizer, most)
    whole = [e.ids + [1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # the second time some are known
        ids, sizes = token_output.token_ids(tokenizer, pa.array(texts, pa.string()), known=known)
        assert ids.tolist() == [i for e in whole for i in e] and sizes.tolist() == [len(e) for e in whole]
    assert len(known.runs) <= most


def test_a_run_is_not_tokenized_again(monkeypatch):
    known, calls = token_output.Known(TOKENS), []
    in_line = token_output.runs_in_line
    monkeypatch.setattr(token_output, "runs_in_line", lambda t, runs: calls.append(list(runs)) or in_line(t, runs))
    assert token_output.cuts_runs(TOKENS)
    for _ in range(2):
        token_output.token_ids(TOKENS, pa.array(["Erst, erst. ERST!", "erst"]), known=known)
    assert calls == [["erst", ",", ".", "!"], []]
