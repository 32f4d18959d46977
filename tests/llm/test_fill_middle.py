import hashlib

from pyspark.sql import functions as F

from tablecheck.llm import fill_middle
from llm_fixtures import awkward, documents, rng, words  # noqa: F401


def expected(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}")


def check(df, rows):
    got = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text", "back").collect()
    assert sorted((tuple(r[:6]) for r in got), key=repr) == sorted((expected(r[0], r[1]) for r in rows), key=repr)
    assert all(r["back"] == (r["text"] or "") for r in got)
    return got


def test_random_texts(documents, rng):
    rows = [(i, " ".join(words(rng, rng.randint(0, 30), "aé漢🙂<P>SM\n")), "en", "s") for i in range(400)]
    got = check(documents(rows), rows)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_very_short_texts(documents):
    rows = [(i, "🙂é<"[: i % 4], "en", "s") for i in range(300)]
    rows += [(1000 + i, s, "en", "s") for i, s in enumerate(("<P>", "x<S>", "<M>y", "<<P", "P>", "<p>"))]
    check(documents(rows), rows)


def test_awkward_rows(documents, awkward):
    check(documents(awkward), awkward)


def test_ids_above_double_precision(documents):
    rows = [(2**53 + 1, "some text", "en", "s"), (None, "some text", "en", "s"), (2**63 - 1, "some text", "en", "s")]
    check(documents(rows, 1), rows)


def test_descriptors(documents):
    """Descriptors cover the text once, without a copy of it, and other rates and seeds count."""
    rows = [(i, "abcdefghij" * 3, "en", "s") for i in range(60)]
    got = fill_middle.fill_in_middle(documents(rows), fim_percent=100, spm_percent=100, seed=5).collect()
    for r in got:
        assert r["form"] == "spm" and [p["buffer"] for p in r["pieces"] if p["buffer"] != "text"] == ["<S>", "<P>", "<M>"]
        parts = sorted((p["start"], p["length"]) for p in r["pieces"] if p["buffer"] == "text")
        assert sum(n for _, n in parts) == 30 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))


def test_empty_table(documents):
    assert fill_middle.fill_in_middle(documents([])).collect() == []
