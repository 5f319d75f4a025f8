import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


def nasty_texts():
    """Null, empty, blank, very long, repeated and odd texts, with passages that they share."""
    r = random.Random(5)
    word = lambda n=400: f"w{r.randrange(n)}"
    base = [word() for _ in range(260)]
    out = [None, "", " \n\t ", "one", "one", "One", "two words", "a b c d e f g h i", " ", "\x1c a\x1cb", "é È ß ß"]
    out += [" ".join(base), " ".join(base), " ".join(base[:200]), " ".join(base[30:110]) + "\n" + " ".join(word(9000) for _ in range(300))]
    for k in range(12):  # near copies
        copy = list(base)
        for _ in range(k * 3):
            copy[r.randrange(len(copy))] = word(10 ** 6)
        out.append(" ".join(copy))
    for k in range(8):  # a shared passage at other places, and twice in one text
        out.append(" ".join([word(9000) for _ in range(7 * k)] + base[100:100 + 46 + k] + [word(9000) for _ in range(20)]))
    out.append(" ".join(base[:60] * 3))
    out += ["x" * 70000, "ab" * 30000 + " " + " ".join(word() for _ in range(3000)), " ".join(word(3) for _ in range(4000)), "\n".join(["same line"] * 30)]
    out += [" ".join(word(5000) for _ in range(r.randrange(1, 120))) for _ in range(60)]
    odd = "aB3 <|endoftext|> ' 's''ll \n\n  \t é漢字🙂 0123 -- ... @ + ( ) token=\"abcdef012345\" AKIA " + "ſecret: KKabcdef "
    out += ["".join(r.choice(odd) for _ in range(r.randrange(1, 400))) for _ in range(60)]
    out += ["token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\" mail a@b.c_x@d.e, 1.2.3.4.5 300.1.1.1 +1 (202) 555-0100 4111 1111 1111 1111-2",
            "password: short, PASSWORD='longer1' apikey=a.b=c- token token: token: abcdefgh", "AKIA" + "A" * 16 + " AKIAB" + "é" + "0" * 24 + "a" * 23 + "G"]
    return out


@pytest.fixture(scope="session")
def nasty(tmp_path_factory):
    """A folder with tables of odd rows; documents have a null id, a clashing and a spare column."""
    folder = tmp_path_factory.mktemp("nasty")
    texts = nasty_texts()
    n = len(texts)
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()),
                             "lang": pa.array([None if k % 7 == 0 else "en" for k in range(n)], pa.string()),
                             "source": pa.array([None if k % 5 == 0 else "s" for k in range(n)], pa.string()),
                             "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
                             "items": pa.array([k for k in range(n)], pa.int64()), "spans": pa.array(["x"] * n)}), folder / "documents.parquet")
    items = [(1, " ".join(texts[11].split()[5:30])), (2, None), (3, "two words"), (4, " - "), (5, "one"), (6, " ".join(texts[11].split()[5:30])),
             (7, "W1 w2 w3"), (8, " ".join(texts[11].split()[100:111])), (10, "é È")]
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}), folder / "benchmark.parquet")
    said = ["", None, "\\", "</turn>", "<turn:", "x:turn>", "<\\turn:a:turn>", "\\\\/turn>", "<turn:turn></turn", "hi é🙂", "\\### Assistant: </turn> ok", "<", ":turn"]
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "tool<turn", "a:turn>b"]), r.choice(said) if t % 3 else "".join(filter(None, r.choices(said, k=4))))
            for c in [None, 1, 2, 3, 4, 5, 6, 7, 8] for t in range(9)]
    pq.write_table(pa.table({"conv_id": pa.array([x[0] for x in rows], pa.int64()), "turn": pa.array([x[1] for x in rows], pa.int64()),
                             "role": [x[2] for x in rows], "text": [x[3] for x in rows], "turns": [1] * len(rows)}), folder / "conversations.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    """The tables without rows."""
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "labels", "conversations", "pages"):
        pq.write_table(pq.read_schema(f"{SF}/{name}.parquet").empty_table(), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session", params=["sf0.001", "nasty"])
def folder(request, nasty):
    return SF if request.param == "sf0.001" else nasty


def rows_of(folder, name, *columns):
    return [tuple(x.values()) for x in pq.read_table(os.path.join(folder, f"{name}.parquet"), columns=list(columns)).to_pylist()]
