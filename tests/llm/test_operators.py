"""Each operator against a brute-force version, a round trip or held-out labels, with odd inputs."""

import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgraph.llm import chat, common, embedding_dedup, fingerprints, mixing, ngram_join, packing, pii, quality, suffix_dedup, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   ", "a b", "a b", "A  B", "one two three four five", "x" * 9000, "w " * 4000, "é" * 300]


def docs(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOC)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near_copies(rng, groups=12, copies=8):
    out = []
    for _ in range(groups):
        base = words(rng, rng.randrange(20, 90)).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = "edit%d" % rng.randrange(10**6)
            out.append(" ".join(own))
    return out


def roots(n, links):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(ngram_join._LOWER)))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def drifting(rng, n=60, size=60):
    """Texts that follow each other in small steps: near neighbours are linked, distant ones are not."""
    out = [words(rng, size, 10**6).split()]
    for _ in range(n - 1):
        own = list(out[-1])
        own[rng.randrange(size)] = f"step{rng.randrange(10**9)}"
        out.append(own)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("sample,common_at,most,block", [(8, 3, 2048, 1 << 19), (1, 3, 10, 400), (8, 10**9, 6, 1 << 19)])
def test_ngram_join_is_exact(spark, sample, common_at, most, block):
    rng = random.Random(1)
    texts = near_copies(rng) + ODD + [words(rng, 40) + " shared passage of seven words here now" for _ in range(20)] + drifting(rng)
    texts += [f"a template of words that all share {i}" for i in range(50)] + near_copies(rng, 1, 60)
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(len(sets), links)
    got = {r.doc_id: r for r in ngram_join.similarity_components(docs(spark, texts), sample=sample, common_at=common_at, most=most, block=block).collect()}
    assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(sets))] == want


def test_ngram_join_empty_table_and_repeated_ids(spark):
    assert ngram_join.similarity_components(docs(spark, [])).count() == 0
    rows = ngram_join.similarity_components(docs(spark, ["a b c d e f"] * 3 + [None], [7, 7, 3, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows if r.doc_id) == [(3, 3), (7, 3), (7, 3)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    want = roots(300, links)
    got = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {i: want[i] for i in {x for e in links for x in e}}


def test_running_sums_place_every_row_once(spark):
    rows = spark.createDataFrame([(i % 2, i, 1 + i % 5) for i in range(500)], "g int, i int, n long")
    for g in (0, 1):
        out = sorted((r.at, r.n) for r in common.running(rows, ["g"], ["i"], "n", "at", fan=16).where(F.col("g") == g).collect())
        assert out[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(out, out[1:], strict=False))


def test_longest_factors_equal_brute_force():
    rng = random.Random(13)
    length, k = 24, 6
    for _ in range(60):
        groups, befores, pieces = [], [], []
        for g in range(rng.randrange(1, 4)):
            anchor, stems = bytes(rng.choices(b"ab", k=k)), [bytes(rng.choices(b"a\0", k=50)) for _ in range(2)]
            for _ in range(rng.randrange(1, 9)):
                stem = bytearray(rng.choice(stems))
                for _ in range(rng.randrange(0, 3)):
                    stem[rng.randrange(50)] = rng.choice(b"a\0c")
                before, behind = rng.randrange(0, length - k + 1), rng.randrange(0, length - k + 1)
                groups.append(g)
                befores.append(before)
                pieces.append(bytes(stem[20 - before : 20]) + anchor + bytes(stem[20 : 20 + behind]))
        got = suffix_dedup.longest_factors(np.array(groups), np.array(befores), pieces, length, k)
        for i, (g, b, x) in enumerate(zip(groups, befores, pieces, strict=True)):
            for l in range(length - k + 1):
                best = 0
                for j, (h, c, y) in enumerate(zip(groups, befores, pieces, strict=True)):
                    if i != j and g == h and b >= l and c >= l and x[b - l : b] == y[c - l : c]:
                        u, v = x[b - l :], y[c - l :]
                        best = max(best, next((n for n in range(min(len(u), len(v))) if u[n] != v[n]), min(len(u), len(v))))
                assert got[l, i] == best, (l, i)


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 1])
def test_suffix_dedup_equals_brute_force(spark, most):
    rng = random.Random(3)
    passage = words(rng, 150)
    texts = [words(rng, rng.randrange(1, 300)) for _ in range(15)]
    texts += [words(rng, 30) + passage[k:] + words(rng, 30) for k in (0, 3, 100, 400)] + [passage, passage, passage[:399], passage[:400], passage[:401]]
    texts += ["ab" * 900, "z" * 1000, "z" * 399, "é" * 500, *ODD]
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, texts), most=most).collect()}
    for i, b in enumerate(raw):
        gone = np.zeros(len(b) + 401, bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), i
        assert bytes(got[i].kept) == kept and got[i].text == kept.decode(errors="replace")


def test_shared_words_equal_brute_force(spark):
    rng = random.Random(23)
    own = lambda n: words(rng, n, 10**6)
    texts = [own(rng.randrange(1, 200)) for _ in range(10)] + ["a b " * 40, own(200).upper()]
    for n in (49, 50, 51, 52, 70, 130, 300):
        passage = own(n)
        texts += [f"{own(30)} {passage} {own(30)}", f"{passage} {own(5)}", f"{own(7)}\n{passage}", f"{own(40)}  " + passage.replace(" ", "\t\n")]
        texts += [f"{passage.upper()} {own(9)}", f"{own(3)} {passage[1:]}"]
    within = own(60)
    texts += [f"{within} {own(20)} {within}", "a " * 50, "a " * 300, "a " * 51 + "b", " ".join("abc"[i % 3] for i in range(400)), " ".join("abc"[i % 3] for i in range(1, 90))]
    texts += near_copies(rng, 6, 6) + [texts[0]] * 3 + [own(50)] * 2 + ["short " * 51] * 2 + ODD
    texts += ["x " + "\x1c".join(own(60).split())] + ["é " * 70, "é " * 60 + "è"]
    told = [(t or "").encode().split() for t in texts]
    assert all(x == re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for x, t in zip(told, texts, strict=True))
    holders = defaultdict(set)
    for i, x in enumerate(told):
        for p in range(len(x) - 50):
            holders[tuple(x[p : p + 51])].add(i)
    want = []
    for x in told:
        covered = set()
        for p in range(len(x) - 50):
            if len(holders[tuple(x[p : p + 51])]) > 1:
                covered.update(range(p, p + 51))
        want.append(len(covered))
    assert len(set(want)) > 15 and 0 in want
    got = {r.doc_id: r.n_shared_words for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_short_passages_of_over_50_words_are_told(spark):
    rng = random.Random(24)
    passage = " ".join(f"w{i}" for i in range(55))  # 209 bytes: no string of 400 bytes repeats
    rows = suffix_dedup.remove_repeats(docs(spark, [f"{words(rng, 80)} {passage} {words(rng, 80)}" for _ in range(2)] + [words(rng, 200)])).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_shared_words) for r in rows) == [(0, 0, 55), (1, 0, 55), (2, 0, 0)]


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def canon(x):
    fold = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold())
    return re.sub(r"\s+", " ", fold).strip()


def test_fingerprints_follow_the_canonical_text(spark):
    texts = ["Straße  X", "STRASSE x ", "ﬁ", "FI", "é", "É", "한", "a b", "A B", "", None, " \n", "other"]
    got = fingerprints.exact_groups(docs(spark, texts)).collect()
    by = {}
    for i, t in enumerate(texts):
        by.setdefault(canon(t or ""), i)
    assert {r.doc_id: r.group_id for r in got} == {i: by[canon(t or "")] for i, t in enumerate(texts)}
    assert len({r.fingerprint for r in got}) == len(by)


@pytest.mark.parametrize("step", [1, 1_000_003])
def test_edited_fingerprints_take_the_next_document(spark, step):
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(0, 12)) for _ in range(300)] + ["", None, "same", "same", "ünï" * 5]
    ids = [i * step for i in range(len(texts))]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs(spark, texts, ids)).collect()}
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].near_edited == float(canon(t) == canon(edited)) and got[i].near_next == float(canon(t) == canon(after))
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (canon(t) == canon(edited))


def test_edited_fingerprints_of_odd_tables(spark):
    assert fingerprints.edited_fingerprints(docs(spark, [])).count() == 0
    assert [r.near_next for r in fingerprints.edited_fingerprints(docs(spark, ["abcd"])).collect()] == [1.0]
    assert fingerprints.edited_fingerprints(docs(spark, ["a", "b", "c", "c"], [None, None, 5, 5])).count() == 4


def test_packing_places_each_id_once(spark):
    rng = random.Random(5)
    texts = [words(rng, rng.randrange(0, 3000)) for _ in range(60)] + [*ODD, "a\x1cb c", "naïve <|endoftext|>x don't\u0085z", "İ ́a", "İ ÀÉ Ñandú, 'S. it's. a,b c.d, ... ..x., é. É,", "<|ENDOFTEXT|> <|endoftext|>."]
    path = common.tokenizer_path()
    packing.token_bytes([""], path)
    tokenizer = packing._loaded[path].tokenizer
    got = packing.pack(docs(spark, texts)).toPandas()
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids) and set(own.doc_tokens) == {len(ids)}
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
    total = got.groupby("sequence_id").length.sum()
    assert sum(4096 - n for n in total if n & (n - 1)) <= 4096 + 0.01 * total.sum()


def test_plan_holds_any_histogram_exactly():
    rng = random.Random(6)
    for _ in range(20):
        h = {n: rng.randrange(1, 50) for n in rng.sample([*range(1, 64), *range(64, 4097, 64)], 30)}
        used = Counter()
        for pattern, times in packing.plan(h):
            assert times > 0 and sum(n * k for n, k in pattern.items()) <= 4096
            used.update({n: k * times for n, k in pattern.items()})
        assert used == h


def test_packing_an_empty_table(spark):
    assert packing.pack(docs(spark, [])).count() == 0


def test_embedding_dedup_recall_and_degrees(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(40):
        base = rng.normal(size=64)
        for _ in range(6):
            v = base + rng.normal(size=64) * rng.uniform(0.02, 0.2)
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], g % 3))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(3)]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [0.0] * 64, 0), (n + 2, [math.nan] * 64, 0), (n + 3, rows[0][1], None), (n + 4, [None] + [1.0] * 63, 0), (n + 5, [], 0), (n + 6, [1e300] * 64, 1), (n + 7, [1e-300] * 64, 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    for block in (2048, 4):
        got = {r.vec_id: r for r in embedding_dedup.near_groups(table, block=block).collect()}
        degrees = np.array([got[i].n_links for i in range(n)])
        assert (degrees <= near.sum(1)).all() and degrees.sum() >= 0.9 * near.sum()
        for i in [*range(n, n + 6)]:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
        assert got[n + 6].n_links == got[n + 7].n_links == 1
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_dedup_of_an_empty_table(spark):
    assert embedding_dedup.near_groups(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


INSULTS = ["fool", "dolt", "oaf"]


def labelled(spark, kind):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(800):
        t, y = words(rng, rng.randrange(5, 200), 3000).split(), int(i % 8 == 0)
        if y and kind == "toxic":
            for _ in range(rng.randrange(1, 4)):
                t.insert(rng.randrange(len(t)), rng.choice(INSULTS) + rng.choice(["", "ish", "s"]))
        if y and kind == "quality":
            t = t[: len(t) // 2] + [w.upper() + "!!" for w in t[len(t) // 2 :]]
        texts.append(" ".join(t))
        labels.append((i, 1 - y if kind == "quality" else 1, y if kind == "toxic" else 0))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(scored, labels, label):
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted == r[label] for r in rows) / len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    return hit


def test_classifiers_on_held_out_rows(spark):
    d, y = labelled(spark, "toxic")
    assert held_out(toxicity.score(d, y), y, "toxic") >= 0.97
    d, y = labelled(spark, "quality")
    assert held_out(quality.score(d, y), y, "quality") >= 0.97


def test_pairwise_terms_learn_what_sums_cannot():
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 2, 2000), rng.integers(0, 2, 2000)
    slots = [np.array([s for s, on in ((1, x), (2, y), (3, 1)) if on]) for x, y in zip(a, b, strict=True)]
    model = toxicity.fit(slots, (a & b).astype(float), epochs=60)
    margin = lambda at: model.bias + model.weights[at].sum() + 0.5 * ((model.factors[at].sum(0) ** 2).sum() - (model.factors[at] ** 2).sum())
    at = {int(s): i for i, s in enumerate(model.slots)}
    assert margin([at[1], at[2]]) > 0 > max(margin([at[1]]), margin([at[2]]))


def test_classifiers_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = docs(spark, ODD)
    for module in (toxicity, quality):
        assert module.score(odd, none).count() == len(ODD)
        assert module.score(docs(spark, []), none).count() == 0


def feistel_values(spark, kind, values):
    frame = spark.createDataFrame([(v,) for v in values], "m string")
    return [r[0] for r in frame.select(pii.pseudonym(F.lit("k"), F.lit(kind), F.col("m"))).collect()]


def luhn(s):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def test_pseudonyms_are_permutations_in_their_format(spark):
    dates = [f"2020-{m:02}-{d:02}" for m in range(1, 13) for d in range(1, 29)]
    out = feistel_values(spark, "date", dates)
    assert len(set(out)) == len(dates) and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", x) for x in out)
    cards = [c for k in range(2000) if luhn(c := f"4111{k:012d}")]
    out = feistel_values(spark, "card", cards)
    assert len(set(out)) == len(cards) and all(len(x) == 16 and luhn(x) for x in out)
    ips = [f"10.0.{a}.{b}" for a in range(20) for b in range(20)]
    out = feistel_values(spark, "ip", ips)
    assert len(set(out)) == len(ips) and all(all(0 <= int(o) <= 255 for o in x.split(".")) for x in out)
    mails = [f"{a}{b}.{i}@x.org" for a in "ab" for b in "cd" for i in range(60)]
    out = feistel_values(spark, "email", mails)
    assert len(set(out)) == len(mails) and all(re.fullmatch(r"[a-z]{2}\.\d{1,2}@x\.org", x) for x in out)
    phones = [f"+1 (743) 555-{i:04}" for i in range(300)]
    out = feistel_values(spark, "phone", phones)
    assert len(set(out)) == len(phones) and all(re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", x) for x in out)


def test_pii_leaves_what_is_not_personal(spark):
    clean = ["Version 2.0. of 256.1.1.1 and 1.2.3.4.5", "4111111111111112", "2020-02-30 and 1999/13/01", "000-12-3456", None, "", "plain", "a@b", "x" * 20000, "1" * 5000, "@" * 3000]
    got = pii.pseudonymise(docs(spark, clean)).orderBy("doc_id").collect()
    assert [r.text for r in got] == clean and all(r.n_card + r.n_ip + r.n_date + r.n_email + r.n_ssn + r.n_phone == 0 for r in got)
    both = pii.pseudonymise(docs(spark, ["call +1 (743) 555-3824!", "x 10.1.2.3, then +1 (743) 555-3824 or 10.1.2.3"])).orderBy("doc_id").collect()
    phone = re.search(r"\+1 \(\d+\) \d+-\d+", both[0].text)[0]
    assert phone != "+1 (743) 555-3824" and phone in both[1].text
    assert len(set(re.findall(r"\d+\.\d+\.\d+\.\d+", both[1].text))) == 1 and (both[1].n_ip, both[1].n_phone) == (2, 1)


def test_pii_dates_of_every_order_and_year(spark):
    every = [d.strftime("%Y-%m-%d") for d in (date(1900, 1, 1), date(2000, 2, 29), date(2099, 8, 5), date(2099, 12, 31))]
    months = [date(y, 1 + i % 12, 1 + i * 7 % 28) for y in range(1900, 2100, 7) for i in range(12)]
    shown = every + [f"{d:%m/%d/%Y}" for d in months] + [f"{d:%d/%m/%Y}" for d in months if d.day > 12] + ["31/12/2020", "31-12-2020", "29/02/2000", "29/02/1904", "30/04/1999", "29/03/2001", "05-01-2024", "31.12.2020"]
    shown = list(dict.fromkeys(shown))
    out = feistel_values(spark, "date", shown)
    assert len(set(out)) == len(shown) and sum(a == b for a, b in zip(shown, out, strict=True)) <= 3
    for a, b in zip(shown, out, strict=True):
        assert re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b)
        if a[2] in "/-":
            first, second, year = int(b[:2]), int(b[3:5]), int(b[6:])
            assert date(year, first, second) if int(a[:2]) <= 12 else first > 12 and date(year, second, first)
        else:
            assert datetime.strptime(b, "%d.%m.%Y" if a[2] == "." else "%Y-%m-%d")
    kept = ["30/02/2020", "32/12/2020", "00/00/2020", "29-02-1900", "000-000-0000"]
    assert [r.text for r in pii.pseudonymise(docs(spark, kept)).orderBy("doc_id").collect()] == kept


def test_pii_of_other_alphabets_and_countries(spark):
    rows = ["jürgen@x.org", "+44 20 7946 0958", "+442079460958", "tel +49 (30) 1234567, 日本@x.org", "jürgen@x.org", ""]
    table = docs(spark, rows)
    got = [r.text for r in pii.pseudonymise(table.unionByName(table)).orderBy("doc_id").collect()]
    assert got[0] == got[1] == got[8] and got[10] == "" and pii.pseudonymise(docs(spark, [])).count() == 0
    assert re.fullmatch(r".{6}@x\.org", got[0]) and got[0][:2] != "jü" and re.fullmatch(r"\+44 \d\d \d{4} \d{4}", got[2]) and got[2] != rows[1]
    assert re.fullmatch(r"\+44\d{10}", got[4]) and got[4] != rows[2] and re.fullmatch(r"tel \+49 \(\d\d\) \d{7}, ..@x\.org", got[6]) and "1234567" not in got[6] and "日本" not in got[6]


def test_pii_with_clashing_columns(spark):
    got = pii.pseudonymise(docs(spark, ["10.1.2.3"]).withColumn("n_ip", F.lit("x")).withColumn("_text", F.lit(1)).drop("_text"))
    assert got.columns.count("n_ip") == 1 and got.first().n_ip == 1


@pytest.mark.parametrize("seed", range(4))
def test_pfair_deviates_by_less_than_a_block(seed):
    rng = random.Random(seed)
    shares = {f"s{i}": rng.randrange(1, 12) for i in range(rng.randrange(1, 15))}
    slots, d, done = mixing.period(shares), sum(shares.values()), Counter()
    order = sorted((x, s) for s, v in slots.items() for x in v)
    assert [x for x, _ in order] == list(range(d))
    for t, (_, s) in enumerate(order, 1):
        done[s] += 1
        assert all(abs(done[k] - c * t / d) < 1 for k, c in shares.items())


def test_schedule_gives_each_block_one_slot():
    rng = random.Random(9)
    shares = {"a": 5, "b": 2, "c": 1}
    totals = {"a": 37, "b": 3, "c": 11, "d": rng.randrange(1, 30)}
    slots = {}
    for s, first, past, c, d, start, own in mixing.schedule(totals, shares):
        for j in range(first, past):
            slots[s, j] = start + (j - first) // c * d + own[(j - first) % c]
    assert sorted(slots.values()) == list(range(sum(totals.values()))) and Counter(s for s, _ in slots) == totals


def test_mixing_keeps_all_rows(spark):
    rng = random.Random(10)
    table = docs(spark, [words(rng, rng.randrange(0, 60)) for _ in range(200)] + ODD + [None]).withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.col("source")))
    got = mixing.mix(table.withColumn("slot", F.lit("x")), {"src0": 3, "src1": 1}, block=500).collect()
    assert len(got) == 211 and len({(r.slot, r.place) for r in got}) == 211
    of = defaultdict(set)
    for r in got:
        of[r.slot].add(r.source)
    assert all(len(s) == 1 for s in of.values())
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_follows_a_plain_schedule_slot_by_slot(spark):
    """Slots made one at a time: of the released blocks the one due first, over the sources that have blocks left."""
    rng = random.Random(12)
    texts = [words(rng, rng.randrange(0, 80)) for _ in range(120)] + ["long " * 500]
    table = docs(spark, texts).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 5 % 3).cast("string")))
    shares, block = {"s0": 4, "s1": 2, "s2": 1}, 300
    got = mixing.mix(table, shares, block=block).collect()
    size = defaultdict(int)
    for r in got:
        size[r.source] += len(r.text) + 1
    left = {s: -(-n // block) for s, n in size.items()}
    order = []
    while any(left.values()):
        now = sorted(s for s in left if left[s])
        d, ran, slot = sum(shares[s] for s in now), dict.fromkeys(now, 0), 0
        while all(left[s] for s in now):
            ready = [(-(-(ran[s] + 1) * d // shares[s]), s) for s in now if ran[s] * d // shares[s] <= slot]
            due, s = min(ready)
            assert slot < due
            order.append((s, ran[s]))
            ran[s] += 1
            left[s] -= 1
            slot += 1
    nth, at = defaultdict(int), {}
    for slot, (s, _) in enumerate(order):
        at[s, nth[s]] = slot
        nth[s] += 1
    for r in got:
        assert r.slot == at[r.source, r.block] and 0 <= r.place < block
    for s in size:
        own = sorted((r for r in got if r.source == s), key=lambda r: (r.slot, r.place))
        starts = [r.block * block + r.place for r in own]
        assert starts == list(itertools.accumulate([len(r.text) + 1 for r in own], initial=0))[:-1]


def test_chat_rotates_every_participant(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "ünd"), (1, 3, "ann", "ünd"), (2, None, None, "x"), (3, 0, "system", "only"), (4, 600, "ann", "late"), (4, 1, "bob", "early")]
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (2, "unknown", None), (4, "ann", 0), (4, "ann", 1), (4, "bob", 0), (4, "bob", 1)}
    r = got[1, "ann", 0]
    assert r.text.startswith("<|im_start|>system\nbe<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n")
    said = [r.text[int(a) : int(b)] for a, b in (x.split(":") for x in r.mask.split(","))]
    assert said == ["hi<|im_end|>", "ünd<|im_end|>", "ünd<|im_end|>"] and r.n_masked == sum(map(len, said)) and r.n_turns == 5
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_columns_of_clashing_names_do_no_harm(spark):
    names = "row c n b blob a z ma k slot block place _text _found _source _at _slice _hash label y score held_out predicted doc_tokens bucket next edited group_id turns spans at mark".split()
    plain = docs(spark, ["one two three four five six", "one two three four five six", "10.1.2.3", None])
    extra = plain.withColumns({x: F.lit("x") for x in names})
    none = spark.createDataFrame([(0, 1, 0, "l"), (1, 0, 1, "l")], "doc_id long, quality int, toxic int, text string")
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(ngram_join.similarity_components(extra)) == key(ngram_join.similarity_components(plain))
    assert key(suffix_dedup.remove_repeats(extra)) == key(suffix_dedup.remove_repeats(plain))
    assert key(packing.pack(extra)) == key(packing.pack(plain))
    assert key(fingerprints.edited_fingerprints(extra)) == key(fingerprints.edited_fingerprints(plain))
    assert key(fingerprints.exact_groups(extra)) == key(fingerprints.exact_groups(plain))
    for module in (toxicity, quality):
        assert key(module.score(extra, none)) == key(module.score(plain, none))
    mixed = mixing.mix(extra)
    assert mixed.count() == 4 and {"block", "slot", "place"} <= set(mixed.columns) and len(mixed.columns) == len(set(mixed.columns))
    shown = pii.pseudonymise(extra)
    assert "10.1.2.3" not in {r.text for r in shown.collect()} and [c for c in shown.columns if not c.startswith("n_")] == [c for c in extra.columns if not c.startswith("n_")]
    turns = spark.createDataFrame([(1, 0, "a", "x", "p")], "conv_id long, turn long, role string, text string, p string")
    assert chat.perspectives(turns).count() == 1
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 0, "q"), (2, [1.0, 2.0], 0, "q")], "vec_id long, embedding array<float>, label int, name string")
    assert [r.n_links for r in embedding_dedup.near_groups(vectors).collect()] == [1, 1]


def test_pii_beside_foreign_digits(spark):
    card, phone, ssn = "4111111111111111", "555-123-4567", "123-45-6789"
    alone = {r.doc_id: r.text for r in pii.pseudonymise(docs(spark, [card, "4111 1111 1111 1111", phone, ssn, "3782 822463 10005", "2020-01-31", "10.1.2.3", "42ann@x.org"])).collect()}
    new, grouped, other, number, amex, day, ip, mail = (alone[i] for i in range(8))
    want = {
        "4111 1111 1111 1111 12/25": f"{grouped} 12/25",
        f"{card} 123": f"{new} 123",
        f"{card}-123": f"{new}-123",
        f"CA 90210 {phone}": f"CA 90210 {other}",
        f"Room 123 {phone}": f"Room 123 {other}",
        f"pay 42 {card}": f"pay 42 {new}",
        "1234 4111 1111 1111 1111 7": f"1234 {grouped} 7",
        f"{card} {card} 4111 1111 1111 1111": f"{new} {new} {grouped}",
        f"7 {card} {ssn} 9 {phone} 2": f"7 {new} {number} 9 {other} 2",
        f"12 3782 822463 10005 {card} 2020-01-31": f"12 {amex} {new} {day}",
        f"{card} 10.1.2.3": f"{new} {ip}",
        f"{card} 42ann@x.org": f"{new} {mail}",
        "1 2 " * 5000: "1 2 " * 5000,
        f"4111111111111112 {card}.": f"4111111111111112 {new}.",
    }
    got = pii.pseudonymise(docs(spark, list(want))).orderBy("doc_id").collect()
    assert [r.text for r in got] == list(want.values())
    assert [r.n_card for r in got] == [1, 1, 1, 0, 0, 1, 1, 3, 1, 2, 1, 1, 0, 1]
    # Other groups than issuers print, as long as nothing foreign is beside them.
    odd = pii.pseudonymise(docs(spark, ["41 1111 1111 111111, 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1"])).first()
    assert odd.n_card == 2 and re.sub(r"\D", "", odd.text) == 2 * new
