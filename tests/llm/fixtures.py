"""Small documents with everything that may go wrong: nulls, blanks, a very long text, ties, repeated rows, clashing columns."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, th string, cid int, _key string"


def texts(seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Éa", "été", "x-y", "don't", "!!", "#", "<|endoftext|>"]
    sentence = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = sentence(70)
    base = [sentence(r.randint(1, 120)) for _ in range(40)]
    out = [None, "", " \n\t ", "one", "two words", "a b c d", "a b c d e", "A B C D e", sentence(6000), "x" * 50_000, "1" * 20_000 + "@" * 50]
    out += base + base[:12] + [base[3]] * 9
    for b in base[:15]:
        w = b.split()
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
        out.append(b.replace(" ", "  ").upper() if len(w) < 30 else b.replace(" ", "\n"))
    out += [f"{sentence(30)}\n{passage}\n{sentence(20)}" for _ in range(6)] + [passage]
    out += ["mail a.b@c.de or +1 (555) 123-4567 at 10.0.0.255, card 4111 1111 1111 1111.", "400.1.1.1 4111111111111112 +12345 a@b"]
    out += [f"see token = \"{i:040x}\" now" for i in range(10**38 + 7, 10**38 + 15)] + [f"the password={i:018x} here" for i in range(10**20, 10**20 + 8)]
    return out


def documents(spark, seed: int = 5):
    rows = [(i * 3 + 1, t, "en", None if i % 11 == 0 else f"s{i % 4}", None, i, "x", 7, "k") for i, t in enumerate(texts(seed))]
    rows.append(rows[20])
    rows.append(rows[20])
    rows.append((None, rows[25][1], None, None, 1, None, None, None, None))
    rows.append((None, "a text without an id of its own here", None, "s1", 1, None, None, None, None))
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def plain(df) -> list[tuple]:
    """(doc_id, text, source) of every row."""
    return [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]


def counted(rows) -> dict:
    from collections import Counter

    return Counter(rows)
