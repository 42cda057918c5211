"""The training-data operators against brute force, exact round trips and held-out accuracy, with the odd inputs of each."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specdag.llm import components as cc
from specdag.llm import decontamination as dc
from specdag.llm import language as lid
from specdag.llm import near_dup, packing, pii, quality_gam, quality_rules, sharding, suffix_tree, toxicity
from specdag.llm.common import remainder
from specdag.llm.grams import word_grams

public_tokenizers = pytest.importorskip("public_tokenizers")
JSON = public_tokenizers.path("byte_bpe_50k.json")
FAST = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, score string, _t int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, first=0):
    """Documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i + first, t, "en" if i % 2 else None, None, None, 1, "x", 2) for i, t in enumerate(texts)], SCHEMA)


def prose(seed, n, words="the of and to in that is was for on are with as his they be at one have this".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + (r.choice("abcdefghijklmnop") * r.randint(0, 2)) for _ in range(n))


ODD = [None, "", " \n\t ", "x", "Ünïcode 日本語 \x1c odd", "<|endoftext|> ends", "a  b   c\n\n\nd", "same text", "same text", "0" * 3000, "word " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = frame(spark, ODD)
    nameless = spark.createDataFrame([(None, "no id", None, None, None, 1, "x", 2), (3, "x", None, None, None, 1, "x", 2)], SCHEMA)
    return rows.unionByName(nameless)


# --- packing -----------------------------------------------------------------


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    found = packing.pack(odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), JSON, longest=64, **FAST).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in found}) == len(found)
    assert set(by) == set(range(len(ODD)))
    for doc, rows in by.items():
        rows.sort(key=lambda r: r["start"])
        want = tokenizer.encode(ODD[doc] or "", add_special_tokens=False).ids + [1]
        assert [i for r in rows for i in r["ids"]] == want
        for r in rows:
            assert r["length"] == len(r["ids"]) == 1 << r["bucket"] <= 64 and r["offset"] == 0 and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())


def test_both_libraries_give_the_same_ids():
    """Over all settled characters, and with the strings of added tokens, as plain ``tokenizers`` reads them."""
    from tokenizers import Tokenizer

    fast, plain = packing.Encoder.of(JSON, **{"ranks": FAST["ranks_path"], "pattern": FAST["pattern"]}), Tokenizer.from_file(JSON)
    r = random.Random(1)
    settled = [chr(c) for c in range(0x250) if packing._SETTLED.fullmatch(chr(c))] + [chr(c) for c in (*range(0x2010, 0x2028), *range(0x2030, 0x203B), 0x20AC)]
    for letters in ("abc DEF '’sé\n\t  0123 .,!?-–€ßñ|#\xa0", settled, [*"ab ", "<|endoftext|>", "<|", "|>"]):
        for _ in range(1500):
            text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
            assert np.frombuffer(fast.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(fast.encode("<|endoftext|> ends"), "<u4").tolist()[0] == 50256


def test_lengths():
    assert packing.lengths_of(1, 8) == [1] and packing.lengths_of(29, 8) == [8, 8, 8, 4, 1] and packing.lengths_of(16, 8) == [8, 8]
    with pytest.raises(ValueError):
        packing.pack(None, JSON, longest=100)


def test_empty_tables(spark, odd):
    none = odd.filter("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    held = lambda i: remainder(i, 5) == 0
    assert packing.pack(none, JSON).count() == 0
    assert sharding.shard(none, 4).count() == 0
    assert quality_rules.ledger(none).count() == 0 and pii.find_pii(none).count() == 0
    assert near_dup.near_duplicates(none).count() == 0
    assert suffix_tree.score(none, held).count() == 0
    assert dc.find_leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert quality_gam.classify(none, quality_gam.fit(none, labels, held)).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels, held)).count() == 0
    assert lid.identify(none, lid.fit(none, held)).count() == 0


# --- sharding ----------------------------------------------------------------


def test_tree_takes_the_tightest_bin():
    r = random.Random(3)
    tree, plain = sharding.Tree(), []
    for b in range(3000):
        entry = (r.randint(0, 500), b)
        tree.add(entry)
        plain.append(entry)
        if b % 3 == 0:
            size = r.randint(0, 500)
            want = min((e for e in plain if e[0] >= size), default=None)
            assert tree.take(size) == want
            if want:
                plain.remove(want)


def test_tree_stays_balanced():
    tree = sharding.Tree()
    for b in range(4096):
        tree.add((b, b))
    assert tree.root.height <= 17
    assert [tree.take(0)[1] for _ in range(4096)] == list(range(4096)) and tree.root is None


def naive_best_fit(sizes, capacity):
    """Bins' loads in the order of opening, item after item."""
    loads, bins = [], []
    for size in sorted(sizes, reverse=True):
        fitting = [(capacity - load - size, b) for b, load in enumerate(loads) if load + size <= capacity]
        b = min(fitting)[1] if fitting else len(loads)
        if not fitting:
            loads.append(0)
        loads[b] += size
        bins.append((size, b))
    return loads, sorted(bins)


@pytest.mark.parametrize("most", [3, 20, 100])
def test_best_fit_decreasing_equals_item_by_item(most):
    r = random.Random(most)
    for _ in range(30):
        sizes = [r.randint(1, most) for _ in range(r.randint(0, 200))]
        classes = list(collections.Counter(sizes).items())
        runs, opened = sharding.best_fit_decreasing(classes, 100)
        loads, bins = naive_best_fit(sizes, 100)
        assert opened == len(loads) and sorted((size, b) for (size, _), own in zip(classes, runs, strict=True) for b, n in own for _ in range(n)) == bins
    with pytest.raises(ValueError):
        sharding.best_fit_decreasing([(101, 1)], 100)


def test_shards(spark, odd):
    docs = odd.unionByName(frame(spark, [prose(i, 5 + i % 50) for i in range(400)] + ["copy of one text"] * 60, 100))
    found = sharding.shard(docs, 7).collect()
    assert len(found) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    by_text, sums, slots = collections.defaultdict(set), collections.Counter(), collections.defaultdict(list)
    for r in found:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
        by_text[raw].add(r["shard"])
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values()) and set(sums) <= set(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) <= max(1.05 * sum(sums.values()) / 7, 16000)
    fixed = sharding.shard(docs, capacity=20_000).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    in_groups = collections.Counter()
    for r in docs.collect():
        in_groups[r["text"] or ""] += len((r["text"] or "").encode()) + 16
    assert [r["b"] for r in sorted(fixed, key=lambda r: r["shard"])] == naive_best_fit(list(in_groups.values()), 20_000)[0]
    with pytest.raises(ValueError):
        sharding.shard(docs)


# --- quality rules -----------------------------------------------------------


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_ledger(spark, odd):
    texts = ["a b c d e f a b c d e g", "a a a a a a", "l one\nl one\nl two\n\n\nl one", "x|y #*$ <z>&%", "one two three four five six", "q w e r t q w e r t"]
    docs = odd.unionByName(frame(spark, texts, 100))
    raw = {r["doc_id"]: r["text"] for r in docs.filter("doc_id IS NOT NULL").collect()}
    for r in quality_rules.ledger(docs).filter("doc_id IS NOT NULL").collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == measured(raw[r["doc_id"]]), raw[r["doc_id"]]


def test_policies_and_ablation(spark, odd):
    rows = quality_rules.apply_policy(quality_rules.ledger(odd), "v1").cache()
    mask = quality_rules.policy_mask("v1")
    assert all(r["kept"] == (r["failed"] & mask == 0) for r in rows.collect())
    table = {r["rule"]: r for r in quality_rules.ablation(rows, "v1").collect()}
    bits = [r["failed"] & mask for r in rows.collect()]
    for rule in quality_rules.RULES:
        if rule.name in table:
            assert table[rule.name]["failed"] == sum(b >> rule.bit & 1 for b in bits) and table[rule.name]["failed_alone"] == sum(b == 1 << rule.bit for b in bits)
    assert table["few_words"]["kept"] == sum(b == 0 for b in bits)


# --- personal data -----------------------------------------------------------

#: The contract's patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def base_spans(text):
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return sorted((m.start(), o, m.end(), k) for o, k in enumerate(BASE) for m in re.finditer(BASE[k], text or "") if ok[k](m.group()))


def test_pii_equals_the_patterns(spark, odd):
    r = random.Random(5)
    alphabet = ["1", "2", "4", "0", " ", "-", ".", "@", "a", "b.c", "+", "(", ")", "é", "_", "%", "4111 1111 1111 1111", "10.0.0.1", "x@y.zz", "+1 (212) 555-0100", "255.256.1.1", "\x01", "\n", "a@b.c_d@e.f", "a@b..c"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(600)]
    texts += ["1 " * 20_000, "a.b" * 20_000 + "@c.d", "x@" + "a." * 20_000 + "z", "+1" + " " * 20_000 + "1", "1." * 20_000, "9" * 50_000]
    docs = odd.unionByName(frame(spark, texts, 100))
    raw = {x["doc_id"]: x["text"] for x in docs.filter("doc_id IS NOT NULL").collect()}
    for row in pii.find_pii(docs).filter("doc_id IS NOT NULL").collect():
        got = [(s["start"], s["order"], s["end"], s["kind"]) for s in row["spans"] if s["base"]]
        assert got == base_spans(raw[row["doc_id"]]), raw[row["doc_id"]][:200]


def test_pii_checksums_context_and_redaction(spark):
    texts = ["my IBAN GB82 WEST 1234 5698 7654 32 here", "my IBAN GB82 WEST 1234 5698 7654 33 here", 'token = "0b96a8c8d79c4a5085c919698889f59b"', "call +1 212 555 0100 now", "or +1 212 555 0100 now", "héllo a@b.cd, 10.0.0.1"]
    found = {r["doc_id"]: r for r in pii.find_pii(frame(spark, texts), keep_text=True).withColumn("clean", pii.redact(F.col("text"), F.col("spans"))).collect()}
    assert [[s["kind"] for s in found[i]["spans"]] for i in range(6)] == [["iban"], [], ["secret"], ["phone"], ["phone"], ["email", "ip"]]
    assert found[3]["spans"][0]["score"] > found[4]["spans"][0]["score"]
    assert found[5]["clean"] == "héllo <EMAIL>, <IP>" and found[0]["clean"] == "my IBAN <IBAN> here"


def test_pii_context_decides(spark):
    texts = ["call 555 123 4567 now", "sum 555 123 4567 now", "ssn 078-05-1120", "part 078-05-1120", "ssn 000-05-1120", "phone: (555) 123-4567", "phone " + "x" * 60 + " (555) 123-4567"]
    found = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["spans"]] for r in pii.find_pii(frame(spark, texts)).collect()}
    assert [found[i] for i in range(7)] == [[("local_phone", 0.6)], [], [("national_id", 0.6)], [], [], [("local_phone", 0.6)], []]


def test_accounts_before_other_capitals(spark):
    de, no = "DE89 3704 0044 0532 0130 00", "NO9386011117947"
    texts = [f"{de} Bitte", f"{de.replace(' ', '')} BIC COBADEFF", f"{de} 12 EUR", f"{no} {no}", f"{de.replace(' ', '')}und", f"x{de}", f"{de}, {de} A", f"{de}1", "AB12 " + "CD34 " * 9 + de]
    found = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "iban"] for r in pii.find_pii(frame(spark, texts), keep_text=True).collect()}
    assert found.pop(8)[-1] == de  # such groups may pass by chance
    assert found == {0: [de], 1: [de.replace(" ", "")], 2: [de], 3: [no, no], 4: [de.replace(" ", "")], 5: [], 6: [de, de], 7: []}


# --- near-duplicates ---------------------------------------------------------


def groups(texts, width):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    comp = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(comp)
        for i, a in enumerate(sets):
            for j in range(i):
                n = len(a & sets[j])
                if a and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            break
    return [len(s) for s in sets], comp


def edited(text, r, share):
    return " ".join(f"new{r.randint(0, 10**6)}" if r.random() < share else w for w in text.split(" "))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    r = random.Random(width)
    texts = [None, "", "  ", "one", "One", "two words", "Two  words", "a a a a a a a a"]
    for g in range(8):
        core = prose(g, r.randint(20, 150), [f"w{r.randint(0, 400)}" for _ in range(120)])
        texts += [core, core.upper()] + [edited(core, r, r.choice([0.005, 0.02, 0.04, 0.06])) for _ in range(r.randint(1, 14))]
    texts += [prose(99, 40) for _ in range(3)] + ["a shared passage of several words " + prose(200 + i, 30) for i in range(20)]
    sizes, comp = groups(texts, width)
    found = {x["doc_id"]: x for x in near_dup.near_duplicates(frame(spark, texts), width=width).collect()}
    assert [found[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [found[i]["component_id"] for i in range(len(texts))] == comp


def test_no_link_of_the_least_similarity_is_lost(spark):
    """Pairs of sets that differ by as many values as a similarity of 0.8 allows, on one side or on both, at any places of the order."""
    r = random.Random(14)
    texts = []
    for _ in range(400):
        shared = [r.getrandbits(40) for _ in range(r.choice([4, 5, 8, 13, 33, 40, 48, 56, 63, 200]))]
        more = len(shared) // 4
        x = r.choice([0, more // 2, r.randint(0, more), more])
        sides = [shared + [r.getrandbits(40) for _ in range(k)] for k in (x, more - x)]
        texts += [" ".join(f"w{v}" for v in r.sample(side, len(side))) for side in sides]
    found = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(frame(spark, texts), width=1).collect()}
    assert [found[i] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]


def test_near_duplicates_of_odd_rows(spark, odd):
    found = near_dup.near_duplicates(odd, width=2).collect()
    assert len(found) == odd.count() and sum(r["component_id"] is None for r in found) == 1
    assert {r["component_id"] for r in found if r["doc_id"] in (7, 8)} == {7}


def test_near_duplicates_with_repeated_ids(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(3, a), (5, a), (5, b), (9, b + " tail"), (9, b + " tail"), (12, "other words"), (12, ""), (None, a)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"] or 0) for x in found) == [(0, 0), (3, 3), (5, 3), (5, 3), (9, 3), (9, 3), (12, 12), (12, 12)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (101, 100), (100, 101)], "a long, b long")
    found = dict(map(tuple, cc.components(links).collect()))
    assert found == {i: 0 for i in range(1, 41)} | {101: 100}


# --- decontamination ---------------------------------------------------------


def test_myers_equals_dynamic_programming():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    r = random.Random(6)
    for _ in range(400):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(1, n))) for n in (30, 60))
        hit = dc.myers(p, t, len(p))
        assert (hit[0] if hit else len(p)) == plain(p, t)


def test_leaks_equal_distances_to_all_parts(spark):
    """Every item and text: found if and only if some part of the text is near enough, with the right place and distance."""
    r = random.Random(15)
    vary = lambda t, n: "".join(c if r.random() > n / len(t) else r.choice(["", "q", c + "z"]) for c in t)
    items = [prose(i, r.randint(1, 12), ["abc", "de", "fgh", "ijkl"]) for i in range(25)]
    texts = [f"{prose(i, 5, ['mn', 'opq'])} {vary(r.choice(items), r.choice([0, 1, 2, 4]))} {prose(i, 4, ['mn', 'abc'])}" for i in range(40)]

    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    def whole(p, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    found = dc.find_leaks(frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), error_rate=0.1).collect()
    normal = [dc.normal(t) for t in texts]
    want = {(i, k) for i, t in enumerate(normal) for k, p in enumerate(map(dc.normal, items)) if distance(p, t) <= int(0.1 * len(p))}
    assert {(x["doc_id"], x["item_id"]) for x in found} == want and len(want) > 20
    for x in found:
        p = dc.normal(items[x["item_id"]])
        assert whole(p, normal[x["doc_id"]][x["start"] : x["end"]]) == x["distance"] <= int(0.1 * len(p))


def test_leaks(spark, odd):
    r = random.Random(7)
    items = [prose(i, 40, [f"term{r.randint(0, 500)}" for _ in range(90)]) for i in range(6)] + ["short one", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def typo(text, n):
        chars = list(text)
        for _ in range(n):
            chars[r.randrange(len(chars))] = r.choice("xyz")
        return "".join(chars)

    texts = [f"{prose(50, 30)} {items[0]} {prose(51, 30)}", f"before. {items[1].upper()}!", typo(items[2], 8), typo(items[3], 60), items[4][: len(items[4]) // 2], "a short, ONE here", "shortone", prose(52, 400), items[5].replace(" ", "\n")]
    docs = odd.unionByName(frame(spark, texts, 100))
    found = {(x["doc_id"], x["item_id"]): x["distance"] for x in dc.find_leaks(docs, bench).collect()}
    assert set(found) == {(100, 0), (101, 1), (102, 2), (105, 6), (108, 5)} and found[100, 0] == 0 < found[102, 2]
    assert {(x["doc_id"], x["item_id"]) for x in dc.find_leaks(docs, bench, block=300).collect()} == set(found)
    kept = dc.remove_leaks(docs, bench, block=400)
    assert kept.columns == docs.columns and {x["doc_id"] for x in docs.collect()} - {x["doc_id"] for x in kept.collect()} == {100, 101, 102, 105, 108}


# --- learned operators -------------------------------------------------------


def tree_scores(tokens, training, depth, least, strength):
    """log10 of each sequence under the tree, in plain Python."""
    after = collections.defaultdict(collections.Counter)
    for t in (t for i, t in tokens.items() if i in training):
        for k, w in enumerate(t):
            history = ["<", *t[:k]][-depth:]
            for d in range(len(history) + 1):
                after[tuple(history[len(history) - d :])][w] += 1
    once, twice = (max(1, sum(n == k for n in after[()].values())) for k in (1, 2))
    unseen, total = max(1.0, once**2 / (2 * twice)), sum(after[()].values())
    weights = {}

    def weight(context):
        if context not in weights:
            own, n = after[context], sum(after[context].values())
            gains = [(0.0, 0)]
            for w in (0.25, 0.5, 1.0, 2.0, 4.0):
                m, gain = w * len(own), 0.0
                for word, k in own.items():
                    q = probability(context[1:], word)
                    gain += k * (math.log((k - 1 + m * q) / (n - 1 + m)) - math.log(q)) if n > 1 else 0
                gains.append((gain, m))
            best = max(gains, key=lambda x: x[0])
            weights[context] = best[1] if n >= least and best[0] > strength else 0
        return weights[context]

    def probability(context, word):
        if not context:
            return (after[()].get(word) or once / unseen) / (total + once)
        q, m = probability(context[1:], word), weight(context) if context in after else 0
        return (after[context][word] + m * q) / (sum(after[context].values()) + m) if m else q

    out = {}
    for i, t in tokens.items():
        out[i] = sum(math.log10(probability(tuple(["<", *t[:k]][-depth:]), w)) for k, w in enumerate(t))
    return out, sum(w > 0 for w in weights.values())


@pytest.mark.parametrize(("buckets", "depth"), [(1, 3), (7, 3), (40, 3), (5, 1)])
def test_suffix_tree_equals_brute_force(spark, buckets, depth):
    """However many buckets there are, and with them hot contexts."""
    r = random.Random(8)
    phrases = [prose(i, r.randint(2, 7), [f"w{k}" for k in range(25)]).split() for i in range(12)]
    texts = [" ".join(w for _ in range(r.randint(1, 12)) for w in r.choice(phrases)) for _ in range(90)]
    texts += texts[:4] + [None, "", "W1 w2\tunseen", "the the the the the the", "x " * 300, " \n"]
    tokens = {i: WORD.findall((t or "").translate(LOWER)) + [None] for i, t in enumerate(texts)}
    training = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2}
    counts = collections.Counter(w for i in training for w in tokens[i])
    total, distinct = sum(counts.values()), len(counts)
    want, kept = tree_scores(tokens, training, depth, 2, 1.0)
    assert kept > 20
    found = suffix_tree.score(frame(spark, texts), lambda i: remainder(i, 7) == 2, buckets=buckets, depth=depth).collect()
    assert sorted(x["doc_id"] for x in found) == list(range(len(texts)))
    for x in found:
        t = tokens[x["doc_id"]]
        assert x["held_out"] == (x["doc_id"] not in training)
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert x["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t))
        assert x["score"] == pytest.approx(want[x["doc_id"]], rel=1e-5)


def test_suffix_tree_tells_copies_and_repeated_rows(spark):
    r = random.Random(12)
    texts = [prose(i, 60, [f"w{k}" for k in range(200)]) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:20])] + [(7, texts[7]), (None, "w1 w2")]
    found = suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string"), lambda i: F.lit(False)).collect()
    assert len(found) == len(rows) and len({x["score"] for x in found if x["doc_id"] == 7}) == 1
    rate = {x["doc_id"]: x["score"] / x["n_tokens"] for x in found}
    assert min(rate[i] for i in range(20)) > max(rate[i] for i in range(20, 60)) and r


def test_suffix_tree_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    size, n = 12, 400
    q = rng.random(size)
    q /= q.sum()
    key, beyond, symbol = rng.integers(1, 4, n).astype(np.uint64), [rng.integers(0, 3, n).astype("<u4") for _ in range(2)], rng.integers(0, 6, n)
    beyond[1] = np.where(beyond[0] > 0, beyond[1], 0)
    asked = np.repeat(np.arange(n), size)
    every = np.concatenate((symbol, np.tile(np.arange(size), n)))
    p = suffix_tree.walk(np.concatenate((key, key[asked])), [np.concatenate((x, x[asked])) for x in beyond], every, q[every], np.arange(len(every)) < n, 2, -1e9)
    assert np.allclose(p[n:].reshape(n, size).sum(1), 1)
    assert not np.allclose(p[n:].reshape(n, size), q)


def test_quality_gam(spark):
    r = random.Random(9)
    good = [prose(i, r.randint(30, 200)) + "." for i in range(150)]
    bad = [" ".join(w + "%%%" for w in prose(i, 60).split()) if i % 2 else prose(i, 8).upper() * 10 for i in range(60)]
    docs = frame(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    held = lambda i: remainder(i, 5) == 0
    model = quality_gam.fit(docs, labels, held)
    found = {x["doc_id"]: x["score"] for x in quality_gam.classify(docs, model).collect()}
    out = [i for i in range(210) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((found[i] >= 0.5) == (i < 150) for i in out) >= 0.95 * len(out)
    assert len(found) == docs.count() and all(0 <= s <= 1 for s in found.values())
    assert model.score(np.zeros((2, len(quality_gam.FEATURES))))[0] == model.score(np.zeros((1, len(quality_gam.FEATURES))))[0]


def test_gam_finds_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.train(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9 and (1, 0) in [p[:2] for p in model.pairs]


def plain_tree(at, size, g, h, ridge):
    """The best tree of three leaves over the bins by trying every cut, as steps of the bins."""
    sums = lambda lo, hi, v: sum(x for x, k in zip(v, at, strict=True) if lo <= k < hi)
    worth = lambda lo, hi: sums(lo, hi, g) ** 2 / (sums(lo, hi, h) + ridge)
    first = max(range(1, size), key=lambda c: (round(worth(0, c) + worth(c, size), 9), -c))
    cuts = [0, first, size]
    options = [(round(worth(a, c) + worth(c, b) - worth(a, b), 9), a, c) for a, b in ((0, first), (first, size)) for c in range(a + 1, b)]
    if options and max(options)[0] > 0:
        gain = max(o[0] for o in options)
        place = max(a for g_, a, _ in options if g_ == gain)
        cuts = sorted({*cuts, min(c for g_, a, c in options if g_ == gain and a == place)})
    return [next(sums(a, b, g) / (sums(a, b, h) + ridge) for a, b in zip(cuts, cuts[1:], strict=False) if a <= k < b) for k in range(size)]


def test_gam_boosting_equals_plain_loops():
    """The tables after some rounds over two features, by loops over rows and all cuts."""
    r = random.Random(4)
    n, rounds, rate, ridge, bins = 120, 5, 0.15, 4.0, 6
    x = [[r.random(), r.random() ** 2] for _ in range(n)]
    y = [int(r.random() < 0.2 + 0.6 * (a > 0.4)) for a, _ in x]
    edges = [sorted(set(np.quantile([row[j] for row in x], [k / bins for k in range(1, bins)]).tolist())) for j in (0, 1)]
    at = [[sum(e <= row[j] for e in edges[j]) for row in x] for j in (0, 1)]
    start = math.log((sum(y) + 0.5) / (n + 1) / (1 - (sum(y) + 0.5) / (n + 1)))
    tables, total = [[0.0] * (len(e) + 1) for e in edges], [start] * n
    for _ in range(rounds):
        for j in (0, 1):
            p = [1 / (1 + math.exp(-t)) for t in total]
            step = plain_tree(at[j], len(tables[j]), [a - b for a, b in zip(y, p, strict=True)], [a * (1 - a) for a in p], ridge)
            tables[j] = [t + rate * s for t, s in zip(tables[j], step, strict=True)]
            total = [t + rate * step[k] for t, k in zip(total, at[j], strict=True)]
    model = quality_gam.train(np.array(x), np.array(y, float), bins=bins, rounds=rounds, rate=rate, ridge=ridge, pairs=0)
    assert all(np.allclose(a, b) for a, b in zip(model.tables, tables, strict=True))
    assert np.allclose(model.score(np.array(x)), [1 / (1 + math.exp(-t)) for t in total])


def test_deobfuscation_and_scores(spark):
    r = random.Random(10)
    insults = ["idiot", "moron", "stupid", "worthless"]
    clean = [prose(i, 60) for i in range(160)]
    toxic = [prose(500 + i, 40) + f" {r.choice(insults)} and {r.choice(insults)} " + prose(900 + i, 20) for i in range(60)]
    docs = frame(spark, clean + toxic)
    labels = spark.createDataFrame([(i, 1, int(i >= 160)) for i in range(220)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, lambda i: remainder(i, 3) == 1)
    for seen, read in (("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuupid", "stupid"), ("w-o-r-t-h-l-e-s-s", "worthless"), ("$tup1d", "stupid")):
        assert toxicity.decode(seen, model.letters) == read
    tests = ["you 1d10t and m0r0n", "a s t u p i d w o r t h l e s s one", "that is for the", None, "", "IDIOT! moron."]
    got = {x["doc_id"]: x["score"] for x in toxicity.score(frame(spark, tests, 1000), model).collect()}
    assert min(got[1000], got[1001], got[1005]) > 0.5 > max(got[1002], got[1003], got[1004])
    held = toxicity.best_words(pa.array(["st" + "u" * 45 + "pid", "y0u.4r3.4.st00p1d.w0rthl3ss.m0r0n.1d10t.4nd.4.st00p1d.m0r0n.st00p1d"]), model, {})
    assert (held[:, 0] > 0).all()  # words too long for one lattice
    doubled = toxicity.best_words(pa.array(["iiddiioott", "ssttuuppiidd"]), model, {})
    assert (doubled[:, 0] > 0).all()
    assert toxicity._spaced(np.array([0, 0, 0, 1]), np.array([0, 4]), np.array([True, False])) == [(0, 0, 3)]
    whole = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    out = [i for i in range(220) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((whole[i] >= 0.5) == (i >= 160) for i in out) >= 0.95 * len(out)


def test_toxicity_learns_from_all_labelled_rows(spark):
    r = random.Random(12)
    insults = ["idiot", "mor0n!", "stupid", "日本語", "x"]
    texts = [prose(i, 4) + (f" {r.choice(insults)} {r.choice(insults)}" if i % 9 == 0 or r.random() < 0.02 else "") for i in range(13_500)]
    labels = [(i, int(i % 9 == 0)) for i in range(13_500)] + [(4, None), (None, 1), (1, 1)]
    model = toxicity.fit(frame(spark, [*texts, None]), spark.createDataFrame(labels, "doc_id long, toxic int"), lambda i: remainder(i, 3) == 1)
    of = {i: t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(of) > 8_000
    toxic, clean = collections.Counter(), collections.Counter()
    for i, text in of.items():
        for w in toxicity._plain(list(set(WORD.findall(text)))):
            (toxic if i % 9 == 0 or i == 1 else clean)[w] += 1
    words = sorted(toxic | clean)
    counts = [np.array([c[w] for w in words], float) for c in (toxic, clean)]
    hashes, weights = toxicity._weights(words, *counts, 4, 25.0)
    assert len(hashes) and model.hashes.tolist() == hashes.tolist() and model.weights.tolist() == pytest.approx(weights.tolist())
    assert model.letters.costs == pytest.approx(toxicity.CharacterModel.of({w: toxic[w] + clean[w] for w in words if w.isalpha()}).costs)
    x = toxicity.best_words(pa.array(list(of.values())), model, {})
    assert model.fit.tolist() == pytest.approx(toxicity._logistic(x, np.array([float(i % 9 == 0 or i == 1) for i in of])).tolist())


def cheapest_readings(seen, model):
    """Every reading of a disguised word with its least cost, by trying all."""
    out = {}

    def go(i, state, cost, read):
        if i == len(seen):
            cost += model.cost(state, "^")
            out[read] = min(cost, out.get(read, math.inf))
            return
        c = seen[i]
        for letter, extra in [(c, 0.0 if c.isalpha() else toxicity.AS_IS)] + [(x, 0.2) for x in toxicity.STANDS_FOR.get(c, "")]:
            go(i + 1, state[1] + letter, cost + extra + model.cost(state, letter), read + letter)
            if letter in (seen[i - 1 : i], state[1]):
                go(i + 1, state, cost + extra + toxicity.REPEATED, read)
        if c in toxicity.SPACING:
            go(i + 1, state, cost + toxicity.DROPPED, read)

    go(0, "^^", 0.0, "")
    return out


def test_decode_equals_all_readings():
    r = random.Random(3)
    model = toxicity.CharacterModel.of(collections.Counter(prose(1, 300, "idiot moron stupid the there noon been".split()).split()))
    for _ in range(300):
        seen = "".join(r.choice("idotmn0134$!.-*|6us") for _ in range(r.randint(1, 6)))
        costs = cheapest_readings(seen, model)
        assert costs[toxicity.decode(seen, model)] == pytest.approx(min(costs.values())), seen


def test_languages_and_spans(spark):
    vocab = {"en": "the house and water with that stone going thing".split(), "de": "das haus und wasser mit dass stein gehen ding".split(), "ru": "дом и вода с тем камень идти вещь".split()}
    r = random.Random(11)
    make = lambda lang, n: " ".join(r.choice(vocab[lang]) for _ in range(n))
    rows = [(i, make(lang, 30), lang) for i, lang in enumerate(list(vocab) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lambda i: remainder(i, 4) == 2
    model = lid.fit(docs, held)
    got = {x["doc_id"]: x for x in lid.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    mixed = [f"{make('en', 30)} {make('de', 20)} {make('ru', 10)}", None, "", "123 !!", "日本"]
    out = [x for x in lid.identify(frame(spark, mixed), model).orderBy("doc_id").collect()]
    assert [(s["lang"], s["first"], s["past"]) for s in out[0]["spans"]] == [("en", 0, 30), ("de", 30, 50), ("ru", 50, 60)]
    assert [x["lang_pred"] for x in out[1:4]] == ["und"] * 3 and out[4]["lang_pred"] in vocab
    assert all(0 <= x["score"] <= 1 for x in out)


def test_language_tables_equal_plain_sums():
    r = random.Random(2)
    counted = [(lang, "".join(r.choice(letters) for _ in range(r.randint(1, 7))) + r.choice(["", ".", "!"]), r.randint(1, 9)) for lang, letters in (("en", "abcdeth"), ("ru", "абвгд"), ("de", "abcäöü")) for _ in range(60)]
    counted += [("en", "123", 5), ("de", "дом", 1)]
    model = lid.train(counted)
    assert model.languages == ["de", "en", "ru"]
    sums = [collections.defaultdict(lambda: 0.2) for _ in model.languages]
    letters = [collections.Counter() for _ in model.languages]
    for lang, word, n in counted:
        k = model.languages.index(lang)
        if any(c.isalpha() for c in word):
            for h in word_grams(lid._plain([word]), lid.SIZES)[1]:
                sums[k][int(h) % lid.BUCKETS] += math.sqrt(n)
            letters[k][max(0, int(lid.word_scripts([word])[0]))] += n
    totals = [sum(x.values()) + 0.2 * (lid.BUCKETS - len(x)) for x in sums]
    for b in set().union(*sums):
        logs = [math.log(x[b] / t) for x, t in zip(sums, totals, strict=True)]
        assert np.allclose(model.table[b], [v - sum(logs) / 3 for v in logs], atol=1e-5)
    for k in range(3):
        for script in range(len(lid.SCRIPTS) + 1):
            assert model.scripts[script, k] == (letters[k][script] > lid.SHARE * sum(letters[k].values()))


def test_toxic_evidence_equals_plain_counts():
    r = random.Random(9)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(2, 5))) for _ in range(150)})
    toxic, clean = np.array([r.randint(0, 6) for _ in words], float), np.array([r.choice([0, 0, 1, 9]) for _ in words], float)
    hashes, weights = toxicity._weights(words, toxic, clean, 4, 5.0)
    sums = collections.defaultdict(lambda: [0.0, 0.0])
    for w, t, c in zip(words, toxic, clean, strict=True):
        for n in toxicity.SIZES:
            for h in word_grams([w], (n,))[1].tolist():
                sums[h][0] += t
                sums[h][1] += c
    nt, nc, want = toxic.sum(), clean.sum(), {}
    for h, (a, b) in sums.items():
        ratio, e = math.log((a + 0.5) / nt) - math.log((b + 0.5) / nc), (a + b) * nt / (nt + nc)
        g = 2 * ((a * math.log(a / e) if a else 0) + (b * math.log(b / (a + b - e)) if b else 0))
        if a >= 4 and ratio > 1.5 and g >= 5.0:
            want[h] = ratio
    assert want and dict(zip(hashes.tolist(), weights.tolist(), strict=True)) == pytest.approx(want)
    x, y = np.array([[r.random(), r.random()] for _ in range(200)]), np.array([float(r.random() < 0.4) for _ in range(200)])
    w = toxicity._logistic(x, y)  # where the likelihood less the penalty has no slope
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert np.allclose([(y - p).sum() - 0.01 * w[0], *((y - p) @ x - w[1:])], 0, atol=1e-6)


def test_viterbi_equals_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    offsets = np.array([0, 5, 5, 6, 12])
    scores = rng.normal(size=(12, 3)) * 2
    path = lid.viterbi(scores, offsets, switch=1.5)
    for a, b in zip(offsets, offsets[1:], strict=False):
        value = lambda p, a=a: sum(scores[a + t, s] for t, s in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        best = max(itertools.product(range(3), repeat=b - a), key=value)
        assert value(tuple(path[a:b])) == pytest.approx(value(best))


def test_learned_operators_take_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(11)], "doc_id long, quality int, toxic int")
    held = lambda i: remainder(i, 5) == 0
    n = odd.count()
    assert quality_gam.classify(odd, quality_gam.fit(odd, labels, held)).count() == n
    assert toxicity.score(odd, toxicity.fit(odd, labels, held)).count() == n
    assert lid.identify(odd, lid.fit(odd, held)).count() == n
    assert suffix_tree.score(odd, held).count() == n
