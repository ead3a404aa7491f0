import math
import random
import re
import textwrap
import tracemalloc
import zlib
from collections import Counter
from decimal import Decimal, localcontext
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridelta.llm import ann, bpe, chat_format, langid, license_scan, lm_scoring, mixing, quality, queries, toxicity
from veridelta.llm.common import WordHashes, words_of

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, row long, at long, n long"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); further columns have names that operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], DOC)


# ---- language ID ----------------------------------------------------------------------------


def test_language_held_out(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op3_language_id"](spark, SF).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.accepted for r in got) >= 0.9 * len(got)


def test_language_odd_rows(spark):
    rows = [(1, "hello there friend", "en", "a"), (2, "bonjour les amis çà", "fr", "a"), (3, None, "en", "a"), (4, "123 ...", None, None), (None, "hello hello", None, "a"), (1, "hello there friend", "en", "a"), (5, "", "en", "b"), (6, "hello " * 30000, None, None)]
    table = docs(spark, rows)
    model = langid.train([(1, "hello there friend", "en"), (2, "bonjour les amis çà", "fr")] * 10)
    got = {r.doc_id: r for r in langid.predict(table, model).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "fr" and got[6].lang_pred == "en"
    assert [(got[i].lang_pred, got[i].score, got[i].accepted) for i in (3, 4, 5)] == [("und", 0.0, False)] * 3
    assert {r.lang_pred for r in langid.predict(table, None).collect()} == {"und"}
    assert langid.learn(table.limit(0)) is None and langid.predict(table.limit(0), model).count() == 0
    assert langid.keep(table, ["doc_id", "text"], model).count() == 5


FOREIGN = {
    "Turkish": "İnsanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Russian": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "Chinese": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "noise": "xq7 zzkw pljf qqv vvbx kjh ghjk wqx zxcv bnmq rtgf plmok njiu hbvg ytfc xdrz eswa qzwx",
}


def test_language_rejection(spark):
    """Foreign text goes; at most one in a hundred held-out documents does. Long texts take little memory."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(table)
    assert not any(model.decide(t)[2] for t in FOREIGN.values())
    got = langid.predict(table, model).withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    got = got.where("held_out and lang_pred <> 'und'").groupBy("accepted").count().collect()
    counts = {r.accepted: r["count"] for r in got}
    assert counts.get(False, 0) <= 0.01 * counts[True]
    text = table.where("lang = 'en'").first().text
    long = (text + " ") * (20_000_000 // len(text))
    tracemalloc.start()
    lang, p, accepted = model.decide(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (lang, accepted) == ("en", True) and peak < 300e6
    ids = langid.features(text)
    assert (langid.bucket_counts(text, 100) == np.bincount(ids, minlength=langid.BUCKETS)).all()


# ---- quality --------------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a b c d e", "x " * 20000]
    texts += ["".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "\x85", " ", "\x1c"]) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    table = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "q", None, None), (7, "q", None, None)])
    got = quality.assess(table).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None and (r.doc_id != 7 or r.n_words != 1):
            want = plain_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)
    clean = " ".join(f"word{i}" for i in range(500))
    assert quality.measure(clean, WordHashes(), 10, quality.NGRAM_LIMITS, 0.3)[6]
    assert not quality.measure(f"{clean}\n" * 3, WordHashes(), 10, quality.NGRAM_LIMITS, 0.3)[6]
    assert quality.assess(table.limit(0)).count() == 0
    assert quality.keep(table, ["doc_id", "text"]).count() == sum(r.kept for r in got)


# ---- toxicity -------------------------------------------------------------------------------


def brute_cosines(index, rows, text):
    """Cosine with every example over the whole vocabulary, from the texts alone."""

    def vector(t):
        counts = {}
        for word in re.findall(r"[^\W\d_]+", (t or "").lower()):
            for term in toxicity.terms_of(word):
                if term in index.vocabulary:
                    counts[term] = counts.get(term, 0) + 1
        w = {x: (1 + math.log(c)) * index.weight[index.vocabulary[x]] for x, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {x: y / norm for x, y in w.items()}

    q = vector(text)
    found = {i: sum(y * q.get(x, 0.0) for x, y in vector(t).items()) for i, t, _ in rows}
    return sorted(((-round(c, 9), i) for i, c in found.items() if c > 0))[: index.k]


def test_nearest_is_exact():
    rng = random.Random(5)
    vocab = [f"w{c}{d}" for c in "abcdefgh" for d in "xyz"] + [f"rare{c}" * 2 for c in "abcdefghijkl"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) + (" insultword" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(30)]  # equal cosines: the smaller doc_id
    for block in (8, 64):
        index = toxicity.build(rows, 0.25, max_df=1.0, block=block)
        assert "insultword" in index.vocabulary and "<insu" in index.vocabulary
        for text in [r[1] for r in rows[:80]] + ["wax wbx unseen", "insultword"]:
            at, cosines = index.nearest(*index.vector(text, {}))
            assert [(-round(c, 9), i) for c, i in zip(cosines, index.ids[at], strict=True)] == brute_cosines(index, rows, text)
    assert index.score("an insultword here", {})[0] > 0.5 > index.score("nothing", {})[0]
    assert index.score("wax " * 300_000, {})[0] < 0.5


def test_nearest_on_documents(spark):
    """All terms stay but function words: every text with a word has evidence, a copy is nearest."""
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = [(r.doc_id, r.text, r.toxic) for r in known.where("toxic is not null and text is not null").collect()]
    index = toxicity.build(rows, 0.1)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").collect()]
    worded = [t for t in texts if re.search(r"[^\W\d_]", t)]
    assert sum(not index.score(t, {})[1] for t in worded) < 0.05 * len(worded)
    for _, text, _ in rows[::25]:
        at, cosines = index.nearest(*index.vector(text, {}))
        assert [(-round(c, 9), i) for c, i in zip(cosines, index.ids[at], strict=True)] == brute_cosines(index, rows, text)
        assert abs(cosines[0] - 1) < 1e-9


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.predicted) for r in queries.QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").collect() if r.doc_id in labels]
    assert sum(a == b for a, b in got) >= 0.97 * len(got)
    assert sum(b for a, b in got if a) >= 0.8 * sum(a for a, b in got)


def test_toxicity_odd_rows(spark):
    table = docs(spark, [(1, None, None, None), (None, "x", None, None), (2, "", None, None), (2, "", None, None)])
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None), (2, 0)], "doc_id long, toxic int")
    index = toxicity.learn(table, labels)
    got = toxicity.score(table, index).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(table.limit(0), index).count() == 0
    assert toxicity.learn(table, labels.limit(0)) is None and {r.score for r in toxicity.score(table, None).collect()} == {0.0}


# ---- LM scoring -----------------------------------------------------------------------------


def test_lattice_against_all_segmentations():
    p = lm_scoring.normalised({"▁": 1.0, "▁a": 2.0, "a": 3.0, "ab": 1.5, "b": 1.0, "▁ab": 0.5, lm_scoring.END: 1.0, **{f"\x00{b:02X}": 0.01 for b in range(256)}})
    lattice = lm_scoring.Lattice(p)

    def total(s):
        if not s:
            return 1.0
        spelt = math.prod(p[f"\x00{b:02X}"] for b in s[0].encode())
        return spelt * total(s[1:]) + sum(p[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    for word in ("a", "ab", "aab", "bbab", "é", "abé"):
        assert math.isclose(lattice.log_probability(word), math.log(total("▁" + word)), rel_tol=1e-9)
        counts = {}
        lattice.expect(word, 1.0, counts)
        # Every segmentation spells the word: expected lengths add up to the word's own bytes.
        spelt = sum(n * (1 if k[0] == "\x00" else len(k.encode())) for k, n in counts.items())
        assert math.isclose(spelt, len(("▁" + word).encode()), rel_tol=1e-6)
    assert lattice.log_probability("ab" * 5000) < -1000


def test_lattice_against_exact_sums_of_any_length():
    """Marginals of the real vocabulary in 60-digit arithmetic, from the end of the word."""
    p = lm_scoring.vocabulary()
    lattice, rng = lm_scoring.Lattice(p), random.Random(8)
    longest = max(map(len, p))
    with localcontext() as context:
        context.prec = 60
        for n in [*range(1, 40), 63, 64, 65, 128, 200]:
            word = "".join(rng.choice("etaoinshrdluéß中😀<9") for _ in range(n))
            s = "▁" + word
            rest = [Decimal(0)] * len(s) + [Decimal(1)]
            for i in range(len(s) - 1, -1, -1):
                rest[i] = math.prod((Decimal(p[f"\x00{b:02X}"]) for b in s[i].encode()), start=Decimal(1)) * rest[i + 1]
                rest[i] += sum(Decimal(p[s[i:j]]) * rest[j] for j in range(i + 1, min(len(s), i + longest) + 1) if s[i:j] in p)
            assert math.isclose(lattice.log_probability(word), float(rest[0].ln()), rel_tol=1e-9)
            counts = {}
            lattice.expect(word, 2.0, counts)
            spelt = sum(x * (1 if k[0] == "\x00" else len(k.encode())) for k, x in counts.items())
            assert math.isclose(spelt, 2 * len(s.encode()), rel_tol=1e-6)


def test_documents_add_up_their_words(spark):
    rows = [(1, "The cat  sat", None, None), (2, None, None, None), (3, "x" * 500 + "\tq", None, None)]
    p = lm_scoring.vocabulary()
    lattice = lm_scoring.Lattice(p)
    for rounds in (0, 1):
        got = {r.doc_id: r.score for r in lm_scoring.score(docs(spark, rows), docs(spark, rows), rounds=rounds).collect()}
        if not rounds:
            for i, text, *_ in rows:
                want = sum(lattice.log_probability(w.decode()) for w in words_of(text)) + math.log(p[lm_scoring.END])
                assert math.isclose(got[i], want / math.log(10), rel_tol=1e-9)
        assert got[1] < got[2] < 0


@pytest.mark.parametrize("hot", [5, 10**6])
def test_base_against_brute_force(spark, hot):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["The", "cat", "sat", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 15))), None, None) for i in range(80)]
    rows += [(80, None, None, None), (81, "", None, None), (None, "only here", None, None), (3, rows[3][1], None, None), (82, "z" * 3000 + " q", None, None)]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c, ends = Counter(), 0
    for i, t, *_ in rows:
        if not out(i):
            c.update(words_of(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    want = []
    for i, t, *_ in rows:
        ws = words_of(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        want.append((str(i), out(i), len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n, round(base, 6)))
    got = lm_scoring.score_held_out(docs(spark, rows), hot_words=hot).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score_held_out(docs(spark, rows[:1]).limit(0)).count() == 0


# ---- chat formatting ------------------------------------------------------------------------


def test_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "bot", "x"), (4, 5, "user", "a"), (5, 0, "user", "a"), (5, 1, "bot", "x"), (6, None, None, None), (7, 0, "user", None), (7, 0, "user", None), (None, 0, "user", "a"), (8, 0, "user", "")]
    rows += [(9, i, "user", f"t{i}") for i in range(3000)] + [(10, i, "user", f"t{i}") for i in range(2500)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, at long, block long")
    got = sorted((r.conv_id, r.part, r.n_turns) for r in chat_format.format_chats(table).collect())
    assert [g for g in got if g[0] < 9] == [(2, 0, 3), (3, 0, 2), (6, 0, 1), (7, 0, 1), (8, 0, 1)]
    assert [g[:2] for g in got if g[0] >= 9] == [(9, i) for i in range(12)]
    text = chat_format.format_chats(table).where("conv_id = 3").first().rendered
    assert text == "<|user|>\na\n<|bot|>\nx\n"
    assert chat_format.format_chats(table.limit(0)).count() == 0


def test_chats_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want = con.execute(queries.ORACLE_SQL["op7_chat_formatting"]).fetchall()
    got = queries.QUERIES["op7_chat_formatting"](spark, SF).select("conv_id", "n_turns", "part", "rendered").collect()
    assert sorted(map(tuple, got)) == sorted(want)


# ---- mixing ---------------------------------------------------------------------------------


def test_weights():
    plan = mixing.plan_weights({"a": 800, "b": 150, "c": 50}, 1000, max_repeats=2.0)
    assert math.isclose(sum(plan.weights.values()), 1) and 0 < plan.exponent < 1
    assert math.isclose(max(plan.budgets[s] / n for s, n in {"a": 800, "b": 150, "c": 50}.items()), 2.0, rel_tol=1e-6)
    flat = mixing.plan_weights({"a": 800, "b": 150, "c": 50}, 1000, max_repeats=None)
    assert flat.exponent == 0 and math.isclose(flat.weights["a"], 1 / 3)
    aimed = mixing.plan_weights({"a": 800, "b": 150, "c": 50}, 1000, max_repeats=None, target_entropy=0.9)
    assert math.isclose(aimed.entropy, 0.9, abs_tol=1e-9)
    with pytest.raises(ValueError):
        mixing.plan_weights({"a": 10}, 100, max_repeats=2.0)


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), None, "big" if i % 3 else rng.choice(["s1", "s2", None])) for i in range(900)]
    rows += [(1, rows[1][1], None, "big"), (None, "a b", None, "s1"), (901, None, None, "void")]
    table = docs(spark, rows)
    tokens = Counter()
    for _, t, _, s in rows:
        tokens[s] += len((t or "").split())
    plan = mixing.plan_weights(dict(tokens), sum(tokens.values()), 2.0)
    got = mixing.mix(table, ["doc_id", "text", "source"], with_plan=True).collect()
    used = Counter()
    for r in got:
        used[r.source] += len((r.text or "").split())
    for s, n in tokens.items():
        if n:
            assert plan.budgets[s] - 35 <= used[s] <= plan.budgets[s] + 1
    copies = Counter((r.doc_id, r.source) for r in got)
    assert max(copies.values()) <= 4 and len({r.block for r in got}) > 100
    assert sum(r.doc_id == 901 for r in got) == 1
    again = mixing.mix(table.repartition(7), ["doc_id", "text", "source"]).collect()
    assert Counter((r.doc_id, r.source) for r in again) == copies
    assert mixing.mix(table.limit(0), ["doc_id"]).count() == 0


# ---- licences -------------------------------------------------------------------------------


def test_licenses(spark):
    mit = next(t for n, t in license_scan.KNOWN if n == "MIT" and len(t) > 500)
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ,")), (2, "text\nLicenced under the Apache Licence, Version 2.0!\nReleased under the MIT License."), (3, mit + " and more"), (4, None), (5, "..."), (None, "Licensed under CC BY 4.0"), (2, "plain"), (6, "word " * 50000)]
    table = docs(spark, [(a, b, None, None) for a, b in rows])
    got = sorted(((r.doc_id or 0, r.text_license, r.line_licenses, r.n_license_lines) for r in license_scan.scan(table).collect()), key=str)
    want = [(1, "MIT", "", 0), (2, None, "Apache-2.0,MIT", 2), (3, None, "", 0), (4, None, "", 0), (5, None, "", 0), (0, "CC-BY-4.0", "CC-BY-4.0", 1), (2, None, "", 0), (6, None, "", 0)]
    assert got == sorted(want, key=str)
    small = license_scan.scan(table, broadcast_rows=1).collect()
    assert sorted(str(tuple(r)) for r in small) == sorted(str(tuple(r)) for r in license_scan.scan(table).collect())
    assert license_scan.scan(table.limit(0)).count() == 0


def test_license_files(spark):
    isc = """ISC License

Copyright (c) 2021, Some Body <a@b.c>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    mit = next(t for n, t in license_scan.KNOWN if n == "MIT" and len(t) > 500)
    files = {p.stem: p.read_text() for p in (Path(license_scan.__file__).parent / "licenses").glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "Unlicense"} <= set(files)
    cases = [("ISC", isc), ("ISC", isc.partition("\n")[2]), ("MIT", "The MIT License (MIT)\n\nCopyright © 2019 A\n\n" + textwrap.fill(mit, 40)), ("MIT", "MIT License\n" + mit)]
    for name, t in files.items():
        body = re.sub(r"(?m)^\s*Copyright \(C\) .*$", "", t)
        cases += [(name, t), (name, t.upper()), (name, "\n".join(textwrap.fill(p, 47) for p in body.split("\n\n")))]
    cases += [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + files["BSD-3-Clause"])]
    cases += [("Apache-2.0", files["Apache-2.0"].partition("APPENDIX:")[0]), ("Apache-2.0", files["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 X")), (None, "Copyright holders have rights"), (None, files["MPL-2.0"][:9000])]
    got = {r.doc_id: r.text_license for r in license_scan.scan(docs(spark, [(i, t, None, None) for i, (_, t) in enumerate(cases)])).collect()}
    assert [(i, got[i]) for i in range(len(cases))] == [(i, n) for i, (n, _) in enumerate(cases)]


# ---- nearest neighbours ---------------------------------------------------------------------


def test_recall_and_exact_scores(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    got = queries.QUERIES["op10_ann"](spark, "/root/testdata/sf0.1").collect()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - rows[q]) ** 2).sum(1))
        want = [i for _, i in sorted(zip(d, ids, strict=True)) if i != q][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(math.isclose(s, math.dist(rows[q], rows[v]), rel_tol=1e-9) for _, v, s in mine)
        hits, total = hits + len(set(want) & {m[1] for m in mine}), total + 10
    assert hits >= 0.9 * total


def test_recall_on_a_larger_table(spark):
    x = np.random.default_rng(3).normal(size=(50_000, 64))
    table = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    got = Counter()
    for r in ann.search(table, every=500).collect():
        got[r.query_id, r.vec_id] += 1
    assert set(got.values()) == {1} and len(got) == 1000
    want = set()
    for q in range(0, len(x), 500):
        d = ((x - x[q]) ** 2).sum(1)
        want |= {(q, int(i)) for i in np.argsort(d)[:11] if i != q}
    assert len(want & got.keys()) >= 0.9 * len(want)


def test_vectors_odd_rows(spark):
    same = [(i, [1.0, 2.0]) for i in range(0, 300)]
    odd = [(1000, None), (1001, [0.0, 0.0]), (1002, [None, 1.0]), (1003, [float("nan"), 1.0]), (1004, [float("inf"), 1.0]), (1005, [1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0]), (400, [1.0, 2.5])]
    table = spark.createDataFrame([(*r, 1, 2) for r in same + odd], "vec_id long, embedding array<float>, cls long, score long")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(table).collect())
    for q in (0, 100, 200):
        assert [(r, v, s) for a, r, v, s in got if a == q] == [(k + 1, v, 0.0) for k, v in enumerate([i for i in range(12) if i != q][:10])]
    assert [(v, s) for a, _, v, s in got if a == 400] == [(i, 0.5) for i in range(10)]
    assert ann.search(table.limit(0)).count() == 0
    assert [(r.query_id, r.vec_id) for r in ann.search(table.where("vec_id in (0, 400)")).collect()] == [(0, 400), (400, 0)]


# ---- pipeline -------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "n-gram Jaccard join", "mixing", "byte-level BPE"]
    got = corpus_pipeline.run(spark, SF)
    n, distinct = got.count(), got.select("doc_id").distinct().count()
    assert 0 < distinct <= n <= 2 * spark.read.parquet(f"{SF}/documents.parquet").count()
    assert {"doc_id", "ids", "n_tokens"} <= set(got.columns)
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_pipeline_stages_against_plain_versions(spark):
    """Each stage on what its predecessor kept, against a version without Spark, on sf0.001."""
    import tiktoken

    import corpus_pipeline
    import public_tokenizers
    from tests.llm.test_ngram_jaccard import brute

    columns = corpus_pipeline.COLUMNS
    extra = docs(spark, [(None, "some words of a text without any id at all in it", "en", "src0"), (7, None, None, None)]).select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars"))
    read = spark.read.parquet(f"{SF}/documents.parquet").select(*columns).unionByName(extra)
    rows = [tuple(r) for r in read.collect()]
    model = langid.learn(read.select("doc_id", "text", "lang"))
    stages = dict(corpus_pipeline.STAGES)
    key = lambda found: sorted(map(str, found))
    frame = lambda found: spark.createDataFrame(found, read.schema)

    got = [tuple(r) for r in stages["language ID"](spark, frame(rows), SF).collect()]
    assert key(got) == key(r for r in rows if model.decide(r[1])[2])
    rows, got = got, [tuple(r) for r in stages["quality rules"](spark, frame(got), SF).collect()]
    assert key(got) == key(r for r in rows if quality.measure(r[1], WordHashes(), 10, quality.NGRAM_LIMITS, quality.LINE_LIMIT)[6])
    rows, got = got, [tuple(r) for r in stages["n-gram Jaccard join"](spark, frame(got), SF).collect()]
    least = {i: c for i, _, c in brute([(r[0], r[1]) for r in rows if r[0] is not None])}
    assert key(got) == key({r for r in rows if r[0] is None or least[r[0]] == r[0]})
    rows, got = got, [tuple(r) for r in stages["mixing"](spark, frame(got), SF).collect()]
    times, tokens = Counter(got), lambda found: Counter({s: sum(len(words_of(r[1])) for r in found if r[3] == s) for s in {r[3] for r in found}})
    plan = mixing.plan_weights(dict(tokens(rows)), sum(tokens(rows).values()), 2.0)
    longest = {s: max(len(words_of(r[1])) for r in rows if r[3] == s) for s in plan.budgets}
    assert set(times) <= set(rows) and max(times.values()) <= 2
    for s, budget in plan.budgets.items():
        assert budget - longest[s] <= tokens(got)[s] <= budget + 1
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_vocabulary()), special_tokens={})
    last = stages["byte-level BPE"](spark, frame(got), SF).collect()
    assert key((r.doc_id, tuple(r.ids)) for r in last) == key((r[0], tuple(enc.encode_ordinary(r[1] or ""))) for r in got)
