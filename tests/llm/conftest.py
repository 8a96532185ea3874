import random

import pytest



def thue_morse() -> list[str]:
    """Words over a and b, and their complements, that any polynomial hash modulo a power of two confuses."""
    out = []
    for k in (10, 11, 12):
        word = "a"
        for _ in range(k):
            word += word.translate(str.maketrans("ab", "ba"))
        out += [word, word.translate(str.maketrans("ab", "ba"))]
    return out


EDGE = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, row int, tokens string, secrets string, part int, items string, component string, name string, key string, node string, digest string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty, blank, very long, exotic and repeated texts, repeated and null ids, columns with clashing names."""
    r = random.Random(3)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "Éclair", "der"]) for _ in range(60_000))
    texts = [None, "", "   \n\t", "one", "two words", "three little words", "a b c d e f g h", "a b c d e f g h", "A B C D E F G H", long, long + " end", "İstanbul ſecret KELVIN   你好 \U0001f642 \x00 \x1f", "token = abcdefgh12345678", "<|endoftext|> plain"]
    rows = [(i if i != 5 else None, t, None if i % 3 else "en", None, None if t is None else len(t), *[None] * 12) for i, t in enumerate(texts)]
    rows += [rows[6], (6, "a b c d e f g h other", "en", "s", 3, *[None] * 12), (None, None, None, None, None, *[None] * 12)]
    return spark.createDataFrame(rows, EDGE)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="session")
def copies():
    """(id, text): texts with near copies of several degrees, a group of many near copies, and a passage that many share."""
    r = random.Random(11)
    words = ["w%d" % k for k in range(4000)] + ["Le", "the", "of"] * 300
    passage = [r.choice(words) for _ in range(45)]
    out, k = [], 0
    for base in range(60):
        text = [r.choice(words) for _ in range(r.choice([3, 6, 9, 14, 25, 60, 150, 400]))]
        if base % 3 == 0:
            at = r.randrange(len(text))
            text[at:at] = passage
        for _ in range(r.choice([1, 1, 2, 4])):
            copy = list(text)
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append((k, " ".join(copy)))
            k += 1
    hub = [r.choice(words) for _ in range(120)]
    for _ in range(120):
        copy = list(hub)
        for _ in range(2):
            copy[r.randrange(len(copy))] = r.choice(words)
        out.append((k, "\n".join(copy)))
        k += 1
    r.shuffle(out)
    return out
