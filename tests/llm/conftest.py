import tempfile
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions under cold northern skies and sing old songs".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * 3 + i * seed) % len(WORDS)] + str((seed + i) % 13) for i in range(n))


def write(folder: str, name: str, columns: dict, schema: dict) -> None:
    pq.write_table(pa.table({c: pa.array(columns.get(c, []), t) for c, t in schema.items()}), f"{folder}/{name}.parquet")


SCHEMAS = {
    "documents": {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64(), "key": pa.string(), "row": pa.int64(), "lang_pred": pa.string(), "n_lines": pa.int64()},
    "benchmark": {"item_id": pa.int64(), "text": pa.string(), "seed": pa.int64()},
    "embeddings": {"vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int64(), "cluster": pa.string(), "v": pa.int64()},
    "labels": {"doc_id": pa.int64(), "quality": pa.int32(), "toxic": pa.int32()},
    "pages": {"page_id": pa.int64(), "url": pa.string(), "html": pa.string(), "host": pa.string()},
    "conversations": {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "segment": pa.int64()},
}


@pytest.fixture(scope="session")
def empty_dir():
    folder = tempfile.mkdtemp(prefix="spark-")
    for name, schema in SCHEMAS.items():
        write(folder, name, {}, schema)
    return folder


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    folder = tempfile.mkdtemp(prefix="spark-")
    long = "  ".join(prose(s, 400) for s in range(40)) + "\n" + "x" * 70_000 + " end"
    base = prose(1, 60)
    passage = prose(77, 40)
    texts = [
        None, "", "   \n\t ", "one", base, base, base + " extra", prose(2, 60), long, long,
        "¡Ñandú! " * 30 + "\U0001f600 ok", "Mail a.b@c-d.example.org now, 10.0.0.256 or 192.168.1.10; +1 (555) 123-4567.", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "key=" + "a1" * 20 + " x",
        prose(5, 30) + " " + passage + " " + prose(6, 30), "Line A\nshared boiler line here\nLine B", None, "shared boiler line here\n\nshared boiler line here",
    ]
    ids = list(range(len(texts)))
    texts += [texts[8], texts[4]]
    ids += [8, 4]  # repeated rows
    texts += [f"shared boiler line here\nown {i} words {prose(i + 20, 12)}" for i in range(8)]
    ids += [100 + i for i in range(8)]
    n = len(texts)
    docs = {"doc_id": ids, "text": texts, "lang": ["en" if i % 3 else None for i in range(n)], "source": ["a" if i % 5 else None for i in range(n)], "n_chars": [None] * n, "key": ["k"] * n, "row": [1] * n, "lang_pred": ["zz"] * n, "n_lines": [9] * n}
    write(folder, "documents", docs, SCHEMAS["documents"])
    write(folder, "benchmark", {"item_id": [0, 1, 2, 3], "text": [passage, None, "", "too short"], "seed": [1] * 4}, SCHEMAS["benchmark"])
    write(folder, "labels", {"doc_id": [3, 4, 4, 7, None, 100], "quality": [1, 0, 1, None, 1, 1], "toxic": [0, 0, 1, 0, 0, None]}, SCHEMAS["labels"])
    vectors = [[((7 * i * j + i) % 13) / 13 - 0.5 for j in range(64)] for i in range(40)]
    vectors += [vectors[3], vectors[3], None, [], [1.0] * 63, [None] + [0.0] * 63, [float("nan")] + [0.0] * 63, [float("inf")] + [0.0] * 63, [0.0] * 64, [-1.5] * 64]
    vec_ids = [*range(40), 3, 77, *range(100, 108)]
    write(folder, "embeddings", {"vec_id": vec_ids, "embedding": vectors, "label": [1] * 50, "cluster": ["c"] * 50, "v": [None] * 50}, SCHEMAS["embeddings"])
    urls = [None, "", "no scheme", "http://Example.COM/en/7/x?q=1", "http://sub.example.com/en/8", "https://example.net#f", "https://x.example.net/de/8", "https://x.example.net/de/9", "http://a.org/es/", "http://notcom/en/", "ftp://com/en/", "http://com"]
    write(folder, "pages", {"page_id": list(range(len(urls))), "url": urls, "html": [None] * len(urls), "host": ["h"] * len(urls)}, SCHEMAS["pages"])
    conv = {"conv_id": [1, 1, 1, 1, 2, None, 3, 3], "turn": [0, 1, 1, None, 0, 0, 0, 0], "role": ["user", "assistant", "assistant", None, "robot", "user", "", "user"], "text": ["Hi?\nUser: quoted", "Yes.", "Yes.", "late", None, "lost", "", "x" * 5000], "segment": [5] * 8}
    write(folder, "conversations", conv, SCHEMAS["conversations"])
    return SimpleNamespace(dir=folder, docs=pd.DataFrame({"doc_id": ids, "text": texts}), urls=urls, passage=passage)
