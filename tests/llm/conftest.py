"""Small tables with the awkward rows that every operator has a defined result for."""
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LONG = " ".join(f"word{i % 977} of the thing" for i in range(12000))
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted"
BASE = " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(60))
CLASH = ["id", "key", "score", "path", "u", "v", "label", "tokens", "block", "conv", "part", "row", "digest", "h1", "data", "x", "n", "weight", "comp1", "__text", "__label", "held_out", "rank", "unit", "family"]


def mod(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def odd_documents() -> list[dict]:
    texts = [None, "", "  \n\t ", "!!! 123 ???", "a", "Hello", LONG, "x" * 30000, BASE, BASE, BASE + " one more", BASE.upper(),
             "Released under the MIT License.\nmit license mit license", "The Apache License\nand the GNU General Public License text",
             "Licensed under CC BY-NC 4.0.", "日本語のテキスト Straße ΣΑΣ İstanbul é", "<|endoftext|> and <|startoftext|>", "\x00 \x1c \x85 \u2028 end",
             "the of and to in is that it for was on with as by this are be", "el la de que y en los del se las por un para con",
             "THIS!! IS!! LOUD!! AND!! BAD!!", "junk*** words$$$ here### and%%% there&&&", "alpha beta", "alpha beta gamma",
             "² ½ ① Ⅷ", "² ½ ① Ⅷ é", " ".join(MIT.split()[:9]) + "\n# " + "\n# ".join(MIT.split()[9:]), (" filler" * 50).join([""] + MIT.split()), f"{BSD} {BSD} {BSD}",
             "MIT LİCENSE the MIT lıcense, mit license. " + " ".join(BSD.split()[1:]) + " " + MIT + " " + BSD.upper(),
             "This wor\u212a is licensed under a Creative Commons Attribution 4.0 International License. This WORK is licensed under a Creative Commons Attribution", "PUBLİC GENERAL Public License ÉÉ general PUBLIC license"]
    rows = [{"doc_id": i, "text": t, "lang": "es" if t and t.startswith("el ") else "en", "source": None, "n_chars": len(t or "")} for i, t in enumerate(texts)]
    rows += [dict(rows[8]), dict(rows[8]), dict(rows[0])]  # repeated rows
    rows += [{"doc_id": None, "text": BASE, "lang": None, "source": "s", "n_chars": None}, {"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}]
    return [{c: f"clash {c}" for c in CLASH} | r for r in rows]


def odd_embeddings() -> list[dict]:
    nan, inf = float("nan"), float("inf")
    rows = [{"vec_id": i, "embedding": [((i * 37 + j * 11) % 23 - 11) / 16 for j in range(8)], "label": 0} for i in range(60)]
    rows += [{"vec_id": 100 + i, "embedding": list(rows[1]["embedding"]), "label": 1} for i in range(40)]  # ties
    rows += [dict(rows[50]), dict(rows[3]), dict(rows[3])]  # repeated rows
    rows += [{"vec_id": 200 + i, "embedding": e, "label": None} for i, e in enumerate([None, [], [0.0] * 8, [None] * 8, [nan] * 8, [inf] + [0.0] * 7, [1.0, -1.0]])]
    return [{c: "x" for c in CLASH} | r for r in rows + [{"vec_id": None, "embedding": [1.0] * 8, "label": 0}]]


def odd_pages() -> list[dict]:
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM", "http://example.com/en/1", "https://www.example.com/en/1?x=/es/", "https://blog.example.com/en/",
            "http://a.net/es/1#f", "http://a.net/es", "net://net/fr/x", "http://spam-farm.example.org/en/728.html?utm=1", "http://www.spam-farm.example.org/en/728/",
            "http://m.other.example.org/en/1", "x://y://z.com/", "http://a.b.c.d.e.f.net/fr/", "http://xnet/fr/", "http://example.com.evil.org/en/", "http://a.net?/es/", "line\nhttp://b.com/\nq"]
    rows = [{"page_id": i, "url": u, "html": None} for i, u in enumerate(urls)]
    rows += [dict(rows[5]), {"page_id": None, "url": urls[5], "html": "x"}, {"page_id": 77, "url": "http://long.com/" + "p/" * 9000, "html": None}]
    return [{c: "x" for c in CLASH} | r for r in rows]


def odd_labels() -> list[dict]:
    rows = [{"doc_id": i, "quality": 0 if i in (20, 21) else 1, "toxic": 0} for i in range(4, 24)]
    rows += [{"doc_id": None, "quality": 1, "toxic": 0}, {"doc_id": 6, "quality": None, "toxic": None}, dict(rows[0]), {"doc_id": 9999, "quality": 0, "toxic": 1}]
    return [{c: "x" for c in CLASH} | r for r in rows]


def odd_conversations() -> list[dict]:
    deep = [(300, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(120)]
    same = [(c, t, "user", f"hello {t}") for c in range(401, 460) for t in range(3)]
    rows = deep + same + [(310 + c, t, "user" if t % 2 else "assistant", f"turn {t}" if t < 7 + 9 * c else f"own {c} {t}") for c in range(9) for t in range(90)]
    rows += [(500, t, "user", f"b {t}") for t in range(2)] + [(501 + c, t, None if t == 1 else "user", None if t == 2 else f"own {t}") for c in range(12) for t in range(c % 7)]
    rows += [(700 + c, None, "system", "first of all") for c in range(8)] + [(700 + c, t, "user", "日本 é\U0001f600") for c in range(8) for t in (-1, 3, 3, 9)]
    rows += [(700, 3, "assistant", "a tie"), (700, 3, "assistant", "another tie"), (-205, 0, "user", "below zero"), (-200, 0, "user", "base below zero"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(9, 0, "", ""), (9, 1, None, None), (8, 0, None, None), (7, 5, "user", "x" * 20000)]
    return [{c: "x" for c in CLASH} | dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows]


SCHEMAS = {
    "documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())],
    "embeddings": [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())],
    "pages": [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())],
    "labels": [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())],
    "benchmark": [("item_id", pa.int64()), ("text", pa.string())],
    "conversations": [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())],
}


def write(folder, tables: dict[str, list[dict]]) -> str:
    for name, fields in SCHEMAS.items():
        rows = tables.get(name, [])
        own = {n for n, _ in fields}
        fields = fields + [(c, pa.string()) for c in (rows[0] if rows else {}) if c not in own]
        pq.write_table(pa.Table.from_pylist(rows, schema=pa.schema(fields)), str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("odd"), {"documents": odd_documents(), "embeddings": odd_embeddings(), "pages": odd_pages(), "labels": odd_labels(),
                                                      "conversations": odd_conversations()})


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="session")
def null_dir(tmp_path_factory):
    """Tables whose every value is null."""
    return write(tmp_path_factory.mktemp("null"), {n: [{c: None for c, _ in f}] * 3 for n, f in SCHEMAS.items()})
