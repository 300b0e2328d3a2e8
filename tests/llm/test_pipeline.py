"""The pipeline against a plain Python version of it."""

import hashlib
import re

import sentencepiece
from tests.llm.test_operators import components, near_pairs

import corpus_pipeline
from cairn.llm import mixing, pieces, quality, secret_scan
from cairn.llm.common import table

SMALL = "/root/testdata/sf0.001"


def plain(rows):
    """(doc_id, ids) for every drawn document."""
    kept = []
    for r in rows:
        words = r.text.split()
        n, letters = len(words), re.sub("[^A-Za-z]", "", r.text)
        ratio = lambda chars, of: len(re.findall(chars, r.text)) / max(of, 1)
        lines = [x for x in r.text.split("\n") if x]
        bad = n == 0 or ratio(r"[#$%&*|<>{}~^=+\\]", len(r.text)) > 0.03 or ratio("[!?]", n) > 0.3
        bad |= len(re.sub("[^A-Z]", "", letters)) / max(len(letters) + 20, 1) > 0.6 or sum(a == b for a, b in zip(words, words[1:])) / (n + 5) > 0.3
        bad |= n / (len(set(words)) + 1) > 20 or (len(lines) - len(set(lines))) / (len(lines) + 4) > 0.5
        bad |= sum(w in "|-*•·" for w in words) / (n + 12) > 0.15 or len(re.findall("[0-9]", r.text)) / (len(r.text) + 20) > 0.5
        bad |= n > 0 and sum(map(len, words)) / n > 25
        if not bad:
            kept.append(r)
    pairs = [(r.doc_id, r.text) for r in kept]
    gone = {i for i, _ in components(near_pairs(pairs), [i for i, _ in pairs])}
    texts = {}
    for r in kept:
        if r.doc_id in gone:
            continue
        spans = []
        for i, (name, p) in enumerate(secret_scan.RULES):
            flag, p = ("(?i)", p[4:]) if p.startswith("(?i)") else ("", p)
            spans += [(m.start(), -m.end(), i, name) for m in re.finditer(f"{flag}(?<![0-9A-Za-z_.~+/-]){p}", r.text, re.A)]
        out, free = "", 0
        for s, e, _, name in sorted(spans):
            if s >= free:
                out += r.text[free:s] + f"[REDACTED:{name}]"
            free = max(free, -e)
        texts[r.doc_id] = (out + r.text[free:], r.source)
    own = {}
    for i, (t, s) in texts.items():
        own.setdefault(s, []).append((hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest(), i, len(t.split())))
    weight = {s: mixing.WEIGHTS.get(s, 1.0) for s in own}
    total = sum(n for x in own.values() for _, _, n in x)
    drawn = []
    for s, x in own.items():
        budget, used = int(total * weight[s] / sum(weight.values())), 0
        while used < budget:
            for _, i, n in sorted(x):
                if used < budget:
                    drawn.append((i, min(n, budget - used)))
                used += n
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    cut = lambda t, n: t if n == len(t.split()) else re.match(r"(?:\s*\S+){%d}" % n, t)[0]
    return sorted((i, lib.encode(cut(texts[i][0], n))) for i, n in drawn)


def test_pipeline_equals_plain_version(spark):
    rows = table(spark, SMALL, "documents").collect()
    got = sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == plain(rows)


def test_stages_lose_no_clean_document(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert quality.filter_documents(good).count() == good.count()


def test_run_with_nulls_repeated_rows_and_string_ids(spark, tmp_path):
    """Every stage by `run`, on rows that are awkward each in their way."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    text = lambda i: " ".join(words[(i * 7 + k * (i % 5 + 1)) % len(words)] + str(i) for k in range(30))
    rows = [(f"d{i}-x", text(i), "en", f"src{i % 3}", 100) for i in range(40)]
    rows += [("d1-x", text(1), "en", "src1", 100)] * 3  # repeated rows
    rows += [("copy", text(2), "en", "src0", 100), (None, text(90), None, None, None), (None, text(91), "en", None, 5)]
    rows += [("none", None, "en", "src0", None), ("empty", "", "en", "src0", 0), ("key", text(95) + " password=abcdefghijklmnop", "en", "src2", 9)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    ids = [r.doc_id for r in got]
    assert {"none", "empty"}.isdisjoint(ids) and len({"copy", "d2-x"} & set(ids)) <= 1 and None in ids
    assert all(r.round_trip for r in got)
    kept = corpus_pipeline.redaction(spark, corpus_pipeline.near_dedup(spark, corpus_pipeline.quality_rules(spark, docs, ""), ""), "")
    assert kept.where("text like '%abcdefghijklmnop%'").count() == 0
    assert kept.where("doc_id = 'd1-x'").count() == 1 and kept.where("doc_id is null").count() == 2


def test_mixed_documents_meet_budgets_exactly(spark):
    rows = [(i, " ".join(["w"] * (3 + i % 11)), f"src{i % 4}") for i in range(60)] + [(7, " ".join(["w"] * 10), "src3")] * 5 + [(None, "a b  c\nd e", None)] * 9
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for total in (None, 311, 997, 12):
        drawn = mixing.mix_documents(docs, total_tokens=total).collect()
        want = mixing.mixture(docs, total_tokens=total).groupBy("source").sum("take_tokens").collect()
        got = {}
        for r in drawn:
            got[r.source] = got.get(r.source, 0) + len(r.text.split())
        assert got == {r[0]: r[1] for r in want if r[1]}
