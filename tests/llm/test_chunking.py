import random

from geoloom.llm import chunking as K
from geoloom.llm.tokens import tokenizer

RND = random.Random(3)


def prose(n):
    out = []
    for k in range(n):
        sent = " ".join(RND.choice(["filter", "the", "coil", "of", "rotor", "Gehäuse", "被动", "x²"]) for _ in range(RND.randrange(4, 16)))
        out.append(sent.capitalize() + RND.choice([". ", ".\n", ".\n\n", "; "]))
    return "ABSTRACT\n" + "".join(out) + "\nCLAIMS\n1. A coil.\n2. A rotor."


TEXTS = {1: prose(700), 2: "short text", 3: "ab1" * 9000, 4: prose(40) + "z9" * 4000 + prose(300), 5: "被动，" * 4000, 6: None, 7: "", 8: prose(150), 9: " \n" * 9000 + "x"}


def check(rows, texts, limit, overlap):
    tok = tokenizer()
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {k for k, t in texts.items() if t and tok.count(t) > limit}
    for k, ps in by.items():
        t = texts[k]
        assert ps[0].first_char == 0 and ps[-1].end_char == len(t) and [p.last for p in ps] == [False] * (len(ps) - 1) + [True]
        for p in ps:
            assert p.piece_text == t[p.first_char : p.end_char] and tok.count(p.piece_text) <= limit
        for a, b in zip(ps, ps[1:]):
            shared = t[b.first_char : a.end_char]
            assert b.first_char < a.end_char and overlap - 4 <= tok.count(shared) <= overlap + 40
    return by


def test_pieces(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string")
    by = check(K.split_documents(df, "doc_id", "text").collect(), TEXTS, K.LIMIT, K.OVERLAP)
    assert all(p.strength >= K.SENTENCE for p in by[1][:-1])


def test_pieces_do_not_depend_on_ranges(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string")
    got = [sorted(map(tuple, K.split_documents(df, "doc_id", "text", range_chars=n).collect())) for n in (1 << 30, 6000, 331)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 10
    runs = {r.key: r.longest_run for r in K.piece_table(df.withColumnRenamed("doc_id", "key"), range_chars=6000).where("last").collect()}
    assert runs[3] > K.LIMIT and runs[1] == 0


def test_files(spark, tmp_path):
    paths = []
    for k in (1, 2, 4, 7):
        p = tmp_path / f"{k}.txt"
        p.write_bytes((TEXTS[k] or "").encode())
        paths.append((str(p),))
    rows = K.split_files(spark.createDataFrame(paths, "path string"), range_bytes=10_000).collect()
    tok = tokenizer()
    for k in (1, 4):
        raw = TEXTS[k].encode()
        ps = sorted((r for r in rows if r.path.endswith(f"{k}.txt")), key=lambda r: r.piece)
        assert ps[0].first_byte == 0 and ps[-1].end_byte == len(raw)
        for p in ps:
            assert p.piece_text == raw[p.first_byte : p.end_byte].decode() and tok.count(p.piece_text) <= K.LIMIT
        for a, b in zip(ps, ps[1:]):
            assert b.first_byte < a.end_byte
    assert not [r for r in rows if r.path.endswith(("2.txt", "7.txt"))]
    for size in (1 << 30, 777):
        again = K.split_files(spark.createDataFrame(paths, "path string"), range_bytes=size).collect()
        cut = lambda x: sorted((r.path, r.piece, r.last, r.first_byte, r.end_byte, r.n_tokens, r.strength) for r in x)
        assert cut(again) == cut(rows)


def test_files_of_broken_bytes(spark, tmp_path):
    p = tmp_path / "x.txt"
    raw = ("word é " * 9000).encode().replace(b"d \xc3\xa9", b"d \xc3", 40)
    p.write_bytes(raw)
    rows = sorted(K.split_files(spark.createDataFrame([(str(p),)], "path string"), range_bytes=5_000).collect(), key=lambda r: r.piece)
    assert rows[0].first_byte == 0 and rows[-1].end_byte == len(raw) and all(r.piece_text == raw[r.first_byte : r.end_byte].decode("utf-8", "replace") for r in rows)


def test_files_and_cells_agree(spark):
    df = spark.createDataFrame([(k, TEXTS[k]) for k in (1, 4, 5)], "doc_id bigint, text string")
    cells = {(r.doc_id, r.piece): r.piece_text for r in K.split_documents(df, "doc_id", "text").collect()}
    files = K.write_files(df, "doc_id", "text")
    got = K.split_files(files, range_bytes=4_000).join(files, "path").collect()
    assert {(r.doc_id, r.piece): r.piece_text for r in got} == cells


def test_empty(spark):
    assert K.split_documents(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0
