import random

import pytest

WORDS = ("the of and to in is for that with this from are was each word stream table join shuffle block hash sort merge window "
         "größe señal été naïve 東京 ключ").split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(90)) if rng.random() < 0.6 else "") for _ in range(n))


def corpus(seed: int = 5, n: int = 60) -> list[tuple[int, str | None]]:
    """Documents with exact and near copies, shared passages and lines, odd white space, nulls, empties and a long text."""
    rng = random.Random(seed)
    passage, line = sentence(rng, 60), "A Shared line of some Length, number one."
    out: list[tuple[int, str | None]] = []
    for i in range(n):
        text = sentence(rng, rng.randrange(1, 160))
        if i % 5 == 1:
            text = f"{text}\n  {line if i % 2 else line.upper()}\t\n{sentence(rng, 30)}"
        if i % 7 == 2:
            text = f"{text}  {passage} {text}"
        if i % 6 == 3 and out[-1][1]:
            words = out[-1][1].split(" ")
            if len(words) > 3 and i % 12 == 3:
                words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        out.append((3 * i + 1, text))
    out += [(1000, None), (1001, ""), (1002, " \n\t\x0b "), (1003, "short one"), (1004, sentence(rng, 6000)), (1005, "\n\n\r\n<|endoftext|> <s> \u0000x"), (0, out[4][1])]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def rows() -> list[tuple[int, str | None]]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus as a table with further columns, some named like the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row string, did string, score string, node int"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "r", "d", "x", 2) for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows without an id, repeated rows, and one id with two texts."""
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    data = [(None, text), (None, text), (None, other), (None, None), (5, text), (5, text), (6, other), (6, text), (7, None), (7, None)]
    return spark.createDataFrame(data, "doc_id long, text string")
