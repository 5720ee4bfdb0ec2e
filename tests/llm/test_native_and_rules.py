import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from trovelens.llm import exact_dedup, quality_rules
from trovelens.plans import skew


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return groups


def check_dedup(got, rows):
    groups = brute_groups(rows)
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        least = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (least, len(ids), r.doc_id == least)
        assert r.doc_id in ids


def test_exact_groups_on_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    check_dedup(exact_dedup.exact_groups(odd_documents).collect(), rows)
    assert exact_dedup.exact_groups(no_documents).collect() == []


def test_shared_identifiers_are_told_apart(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    weak = lambda c: F.pmod(F.length(c), F.lit(2))  # noqa: E731 - nearly every identifier is shared
    check_dedup(exact_dedup.exact_groups(odd_documents, weak).collect(), rows)


def test_chunks_concatenate_and_shift(spark):
    r = random.Random(4)
    text = " ".join("".join(r.choice("abcdefghijklmnoprstuw") for _ in range(r.randint(1, 9))) for _ in range(20_000))
    df = spark.createDataFrame([(text,), ("shifted by something " + text,), ("",)], "t string")
    a, b, c = [r[0] for r in df.select(exact_dedup.chunks(F.col("t"))).collect()]
    assert "".join(a) == text and c == []
    assert all(len(x) <= exact_dedup.MAX_CHARS for x in a)
    assert len(set(a) & set(b)) > len(a) / 2  # cuts follow the content


def test_deduplicated_keeps_columns_and_one_row(odd_documents):
    out = exact_dedup.deduplicated(odd_documents)
    assert out.columns == odd_documents.columns
    ids = Counter(r.doc_id for r in out.collect())
    assert ids[8] == 0 and ids[7] == 1 and ids[13] == 1 and ids[None] == 1


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeats = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeats)


def test_quality_counts(odd_documents, no_documents):
    for r in quality_rules.cleaned(odd_documents).join(odd_documents.select("doc_id", "text").distinct(), "doc_id").collect():
        n, chars, symbols, dup, repeats = plain_counts(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.kept and r.base_failed)
    assert quality_rules.cleaned(no_documents).count() == 0


def test_lines_decide():
    r = random.Random(6)
    good = "This is a fine line with several words, and it ends here.\n"
    clean = "".join(" ".join(f"w{r.randint(0, 9999)}" for _ in range(12)) + ".\n" for _ in range(20))
    assert quality_rules.measure(clean)[6]
    some = clean + "Home\nAll rights reserved.\n"
    kept = quality_rules.measure(some)
    assert kept[6] and "Home" not in kept[8] and "rights" not in kept[8]
    for line in ("Weiter", "» Zurück", "Lire la suite", "Iniciar sesión", "Alle Rechte vorbehalten.", "Política de privacidad", "Mentions légales"):
        assert line not in quality_rules.measure(clean + line + "\n")[8], line
    junk = "\n".join(f"what{i}*** ever{i}%%% this{i}$$$ is{i}&&&" for i in range(40))
    assert not quality_rules.measure(junk + "\n" + good)[6]


def brute_deduplicated(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted((key, min(ids, key=lambda i: (i is None, i or 0))) for key, ids in groups.items())


def test_rows_are_told_apart_by_id_and_text(spark):
    rows = [(1, "a b c"), (1, "different text"), (3, "zzz"), (5, "zzz"), (5, "yyy"), (None, "q"), (None, "r"), (None, "q"), (7, None), (8, ""), (9, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(3)
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id) for r in got.collect()) == brute_deduplicated(rows)


def test_hot_groups_are_salted(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 100)
    rows = [(i, "the same   text" if i % 3 else f"text {i // 2}") for i in range(6000)] + [(None, "the same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_dedup(exact_dedup.exact_groups(docs).collect(), rows)
    got = exact_dedup.deduplicated(docs).collect()
    assert sorted((re.sub(r"\s+", " ", r.text), r.doc_id) for r in got) == brute_deduplicated(rows)
