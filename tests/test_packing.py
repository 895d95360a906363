"""Chunks of long texts by jumps, against a plain loop and against the fold inside one row."""

import random

from pyspark.sql import functions as F

from tidelog.operators import evidence as ev


def looped(text, most):
    """Chunks of paragraphs in order."""
    out, held = [], ""
    for p in (x.strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n\n")):
        if not p:
            continue
        if held and len(held.encode()) + 2 + len(p.encode()) <= most:
            held += "\n\n" + p
        else:
            out += [held] if held else []
            held = p
    return out + ([held] if held else [])


def test_jumps_give_the_chunks_of_the_loop(spark):
    r = random.Random(4)
    texts = {f"s{k}": r.choice(["\n\n", "\r\n\r\n", "\n\n \n\n"]).join(r.choice(["", "ü", "x"]) * r.randrange(1, 60) for _ in range(r.randrange(0, 80))) for k in range(25)}
    texts |= {"empty": "", "blank": " \n\n \n", "one": "p", "huge": "y" * 900 + "\n\nz\n\nz", "exact": "a" * 48 + "\n\n" + "b" * 50 + "\n\n" + "c" * 50}
    rows = spark.createDataFrame([*texts.items(), ("null", None)], "source_id string, text string")
    for most in (1, 100):
        expected = {(s, i): c for s, t in texts.items() for i, c in enumerate(looped(t, most))}
        for got in (ev.packed_by_jumps(rows, most), ev.chunks(rows, most, long_bytes=200)):
            assert {(x.source_id, x.ordinal): x.text for x in got.collect()} == expected


def test_a_text_of_100_megabytes(spark):
    r = random.Random(5)
    text = "\n\n".join("w" * r.randrange(200, 2400) for _ in range(77_000))
    assert len(text) > 99_000_000
    expected = looped(text, ev.CHUNK_BYTES)
    rows = spark.createDataFrame([("s", text[: len(text) // 2], text[len(text) // 2 :])], "source_id string, a string, b string").select("source_id", F.concat("a", "b").alias("text"))
    got = {x.ordinal: (x.n, x.h) for x in ev.chunks(rows).select("ordinal", F.length("text").alias("n"), F.substring("text", 1, 9).alias("h")).collect()}
    assert got == {i: (len(c), c[:9]) for i, c in enumerate(expected)}


def test_a_registered_file_that_gives_no_text_is_an_error(spark, tmp_path):
    import pytest


    (tmp_path / "a b.txt").write_text("one\n\ntwo")
    for path in (str(tmp_path / "a b.txt"), f"file:{tmp_path}/a b.txt"):
        source = ev.new_source(spark, "freeform_text", "file", "l", "t", path=path)
        assert [x.text for x in ev.source_texts(spark, source).collect()] == ["one\n\ntwo"]
    with pytest.raises(Exception, match="AI_EVIDENCE_SOURCE_INVALID|PATH_NOT_FOUND"):
        ev.source_texts(spark, ev.new_source(spark, "freeform_text", "file", "l", "t", path=str(tmp_path / "none.txt"))).collect()
