"""Chat formatting, filter audit and infilling against brute force, on tables with the awkward cases."""

import hashlib
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tallyframe.llm import audit, chat, infill, queries
from tallyframe.llm.store import table
from tallyframe.llm.textbuf import TextBuffer
from tests.conftest import SF001

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, `TEXT` string, digest int, fails int, part string, n int"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def rows_of(texts, langs=("en", "fr", None, "")):
    return [(i, t, langs[i % len(langs)], "s", "x", 1, 2, "p", 3) for i, t in enumerate(texts)]


def some_texts():
    rnd = random.Random(5)
    words = ["alpha", "Beta", "é😀", "GAMMA", "x", "a#b", "50%", "ß\u0085", "d\x1ce"]
    out = [None, "", " ", "\n\n", "word", " lead", "trail \n", "a\x0bb\x0cc\r\nd", "<P> held", "a <S>", "<M", "é", "\xa0 　"]
    for n in (3, 30, 99, 100, 101, 150, 400):
        for k in range(4):
            pool = words[:1 + 2 * k] if k else [f"w{i}" for i in range(500)]
            out.append("".join(rnd.choice(pool) + rnd.choice([" ", "\n", "  ", "\t "]) for _ in range(n)))
    out.append(" ".join(f"t{i}" for i in range(30_000)))
    return out + out[5:25] + out[20:30]


# ---- infilling

def brute_fim(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(tokens[:i]), "".join(tokens[i:j]), "".join(tokens[j:])
    assert pre + mid + suf == text
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    spm = h4 % 100 < 80
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, "spm" if spm else "psm", len(pre), len(mid), sha(out), sha(text)


def test_infilling_equals_brute_force(spark):
    texts = some_texts()
    rows = [(None if i % 17 == 3 else i // 2 * 7, *r[1:]) for i, r in enumerate(rows_of(texts))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, infill.digests(docs).collect()), key=str)
    assert got == sorted(((r[0], *brute_fim(r[0], r[1])) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infill.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_infilling_of_a_whole_table(spark):
    docs = table(spark, SF001, "documents")
    got = {r[0]: tuple(r[1:]) for r in queries.op13_infill(spark, SF001).collect()}
    assert got == {r.doc_id: brute_fim(r.doc_id, r.text) for r in docs.collect()}


def test_wavelet_ranks_and_line_cuts():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rnd.integers(0, 7, n).astype(np.uint8)
        m = infill.WaveletMatrix(symbols, 3)
        at = np.arange(n + 1)
        for s in range(8):
            assert m.rank(s, at).tolist() == [int((symbols[:p] == s).sum()) for p in at]
    import pyarrow as pa

    texts = ["", "\n", "a", "a\nb", "a\n\nb\n", " \n é\n"]
    units = infill.Units(TextBuffer(pa.array(texts)), "line")
    lines = [re.findall(r"[^\n]*\n|[^\n]+", t) for t in texts]
    assert units.n.tolist() == [len(x) for x in lines]
    for k in range(4):
        want = [int(low) + len("".join(x[:k]).encode()) for low, x in zip(units.low, lines, strict=True)]
        assert units.end(np.full(len(texts), k)).tolist() == want


# ---- filter audit

def brute_audit(rows, labels):
    seen, marks = {}, {}
    for i, q, t in labels:
        if i is not None:
            old = marks.get(i, (0, 0))
            marks[i] = (max(old[0], q or 0), max(old[1], t or 0))
    for r in rows:
        if r[0] is not None:
            seen[r[1] or ""] = min(r[0], seen.get(r[1] or "", r[0]))
    docs = []
    for r in rows:
        text = r[1] or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": r[0] is not None and seen[text] < r[0]}
        docs.append((r[2] or "", fails, marks.get(r[0], (0, 0))))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                here = [d for d in mine if not any(d[1][g] for g in order[:step - 1])]
                gone = [d for d in here if d[1][f]]
                out[part, order, step] = [
                    len(here) - len(gone), len(gone), sum(d[1][f] for d in mine) - len(gone),
                    sum(d[1][f] and sum(d[1].values()) == 1 for d in mine),
                    sum(d[2][0] == 1 for d in gone), sum(d[2][1] == 1 for d in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    texts = some_texts()
    rows = [(None if i % 13 == 5 else 100 - i // 2, *r[1:]) for i, r in enumerate(rows_of(texts))]
    rows += rows[10:30]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(40, 100, 3)] + [(61, 1, 1), (None, 1, 1), (64, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in audit.audit(docs, labelled).collect()}
    assert got == brute_audit(rows, labels)
    none = spark.createDataFrame([], SCHEMA)
    assert audit.audit(none, labelled).count() == 0
    without = {(r[0], r[1], r[2]): tuple(r[3:]) for r in audit.audit(docs, labelled.limit(0)).collect()}
    assert without == brute_audit(rows, [])


def test_audit_oracle(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    rel = con.execute(audit.oracle())
    names = [d[0] for d in rel.description]
    df = queries.op12_filter_audit(spark, SF001)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())


def test_position_counts():
    rnd = np.random.default_rng(1)
    counter, want = audit.PositionCounts(), [0] * 32
    for n in (1, 255, 256, 257, 5000):
        words, times = rnd.integers(0, 1 << 32, n, dtype=np.uint32), rnd.integers(0, 1000, n)
        counter.add_times(words, times)
        want = [w + int(((words >> p & 1) * times).sum()) for p, w in enumerate(want)]
    counter.add_times(np.array([1 << 31], np.uint32), np.array([1 << 40]))
    want[31] += 1 << 40
    assert counter.totals() == want


# ---- chat formatting

def test_escaping_is_exact_and_leaves_no_control_strings():
    rnd = random.Random(2)
    bits = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "SYS]", "/SYS]", "ROLE]", "/ROLE]", "IMAGE]", "AUDIO]", "DOCUMENT]", " ", "x", "é😀", "\n"]
    held = re.compile(r"</?s>|\[/?(?:INST|SYS|ROLE)\]|\[(?:IMAGE|AUDIO|DOCUMENT)\]")
    for _ in range(20_000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))
        out = chat.escape(text)
        assert chat.unescape(out) == text
        assert not held.search(out)


def test_parts_are_flattened_in_order():
    parts = [{"type": "text", "text": "see [IN"}, {"type": "text", "text": "ST] and [IMAGE]"},
             {"type": "image", "ref": "a.png", "width": 1025, "height": 512}, None,
             {"type": "audio", "ref": "b.wav", "seconds": 1.01}, {"type": "text", "text": None},
             {"type": "document", "ref": None, "pages": 3}, {"type": "text", "text": "end"}]
    v = chat.format_turn("assistant", parts)
    text = "".join(v.out)
    assert text == "<s>see [\\INST] and [\\IMAGE][IMAGE][AUDIO][DOCUMENT]end</s>"
    assert [(a["kind"], a["ref"], a["tokens"], text[a["start"]:a["end"]]) for a in v.attachments] == [
        ("image", "a.png", 3 * 256, "[IMAGE]"), ("audio", "b.wav", 26, "[AUDIO]"), ("document", None, 3 * 768, "[DOCUMENT]")]
    assert [chat.unescape(text[s:e]) for s, e in v.spans] == ["see [INST] and [IMAGE]", "", "end"]
    assert chat.parse(text) == [("assistant", ["see [INST] and [IMAGE]", "[IMAGE]", "", "[AUDIO]", "", "[DOCUMENT]", "end"])]
    with pytest.raises(ValueError, match="unknown kind"):
        chat.format_turn("user", [{"type": "video"}])


CONVS = "conv_id long, turn long, role string, text string, `TEXT` string, `range` int, place int"


def chats():
    rnd = random.Random(9)
    say = lambda: "".join(rnd.choice(["</s>", "[INST] ", "hi ", "é😀\n", "\\", "<", "[/INST]", "\ntext "]) for _ in range(rnd.randint(0, 9)))
    rows = []
    for c in range(60):
        for t in range(rnd.randint(1, 6)):
            rows.append((c, t, rnd.choice(["user", "assistant", "system", "tool", "[/ROLE]x", "", None, "User"]), say()))
    rows += [(100, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * 60) for i in range(1500)]       # over many ranges
    rows += [(101, 0, "assistant", None), (101, None, "assistant", "no turn"), (101, 0, "assistant", "tie"), (101, 0, "assistant", "tie")]
    rows += [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (102, 0, "assistant", "long " * 100_000), (103, 0, "system", "")]
    rnd.shuffle(rows)
    return [(*r, "x", 1, 2) for r in rows]


def brute_chat(rows, tie):
    out = {}
    for key in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, tie[r[2], r[3]]))
        spoken = [r[3] or "" for r in turns if r[2] == "assistant"]
        text = "".join("".join(chat.format_turn(r[2], [{"type": "text", "text": r[3]}]).out) for r in turns)
        assert ["".join([role, "\n", *parts]) for role, parts in chat.parse(text)] == [f"{r[2] or ''}\n{r[3] or ''}" for r in turns]
        out[key] = (len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)),
                    sum(map(len, spoken)), sha("".join(spoken)), len(text))
    return out


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_chat_equals_brute_force(spark, partitions):
    from pyspark.sql import functions as F

    rows = chats()
    df = spark.createDataFrame(rows, CONVS).repartition(5)
    tie = {(r.role, r.text): r.h for r in df.toDF("c", "t", "role", "text", "a", "b", "d").select("role", "text", F.xxhash64("role", "text").alias("h")).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r[0]: tuple(r[1:]) for r in chat.read_back(chat.format_conversations(df)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_chat(rows, tie)


def test_chat_tables(spark):
    none = spark.createDataFrame([], CONVS)
    assert chat.read_back(chat.format_conversations(none)).count() == 0
    mark, image = ("text", "<s>", None, None, None, None, None), ("image", None, "a.png", 10, 20, None, None)
    typed = spark.createDataFrame([(1, 0, "assistant", [mark, image, mark], "other")],
                                  f"conv_id long, turn long, role string, content {chat.PARTS}, text string")
    row = chat.format_conversations(typed).first()
    assert row.formatted == "<s><\\s>[IMAGE]<\\s></s>" and row.tokens == 256
    assert [(a.ref, a.start, a.end) for a in row.attachments] == [("a.png", 7, 14)]
    assert [row.formatted[s.start:s.end] for s in row.loss] == ["<\\s>", "<\\s>"]
    back = chat.read_back(chat.format_conversations(typed)).first()
    assert (back.n_turns, back.loss_chars, back.loss_sha256) == (1, 6, sha("<s><s>"))


def test_chat_of_a_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF001, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", queries.SAID), (-7, 1, "assistant", queries.SAID)]
    got = {r[0]: tuple(r[1:]) for r in queries.op11_chat_format(spark, SF001).collect()}
    assert got == brute_chat(rows, {(r[2], r[3]): 0 for r in rows})
