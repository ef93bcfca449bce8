from discloscope.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, kept_text string, n_lines int"
LONG = "This line has more than twenty signs"


def brute(rows, min_chars=20, min_docs=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (i is not None and len(h := held.get(key(x), ())) >= min_docs and i < max(h))]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_odd_texts(spark):
    rows = [(1, f"a\n {LONG}\t\nb"), (2, f"{LONG.upper()}\n{LONG}"), (3, f"\n{LONG}\n\nÉ{LONG}"), (4, None), (5, ""), (None, LONG), (None, None),
            (6, f"é{LONG}"), (7, f"é{LONG}\nx"), (8, f"É{LONG}\r\nÉ{LONG}"), (9, f"é{LONG}"), (10, "\n" * 50 + f"{LONG} 2"), (11, f"{LONG} 2"),
            (12, f"{LONG} 2"), (13, f"{LONG} 2"), (13, f"{LONG} 2"), (13, f"other\n{LONG} 2\nend")]
    docs = spark.createDataFrame([(i, t, "old", 7) for i, t in rows], SCHEMA)
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "kept_text", "n_lines", "n_dropped"]
    assert order((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in out.collect()) == order(brute(rows))


def test_many_cuts_in_one_document(spark):
    lines = [f"{LONG} number {i}" for i in range(3000)]
    rows = [(i, "\n".join(["head", *lines, "tail"])) for i in range(3)]
    out = dedup_lines(spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)).collect()
    assert order((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in out) == order(brute(rows))


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
