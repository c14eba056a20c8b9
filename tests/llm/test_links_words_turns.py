"""Embedding links, spelling variants and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockpipe.llm import caps, queries, repair, spelling

SF = "/root/testdata/sf0.001"


# --- 11: links between vectors ---------------------------------------------------------------


def plain_links(rows: list[tuple], threshold: float = 0.9) -> list[tuple]:
    def usable(x):
        return x is not None and None not in x and np.isfinite(x).all() and any(x)

    units = [np.array(x, dtype=np.float64) / np.abs(x).max() if usable(x) else None for _, x in rows]
    units = [x if x is None else x / np.sqrt(x @ x) for x in units]

    def cosine(x, y):
        return -1.0 if x is None or y is None or len(x) != len(y) else x @ y

    n = len(rows)
    links = [[j for j in range(n) if j != i and cosine(units[i], units[j]) >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids, default=None)))
    return out


def found_links(df, **kw) -> list[tuple]:
    got = caps.linked_vectors(df, **kw)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    out = [tuple(r) for r in got.collect()]
    assert all(kept == (v == c) for v, _, c, kept in out)
    return [r[:3] for r in out]


def by_text(rows):
    return sorted(rows, key=str)


def clumps(seed: int, dimensions: int, spread: float, sizes: list[int]) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    out = []
    for size in sizes:
        centre = rng.normal(size=dimensions)
        out += [centre + spread * rng.normal(size=dimensions) for _ in range(size)]
    return out


def test_vector_query_matches_all_pairs(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    want = plain_links([(i, x.tolist()) for i, x in zip(data["vec_id"], data["embedding"])])
    got = queries.QUERIES["op11_cap_filters"](spark, SF).collect()
    assert by_text([tuple(r)[:3] for r in got]) == by_text(want)


@pytest.mark.parametrize("block", [2048, 16])
def test_clumps_are_linked_whole_and_counted_once(spark, block):
    vectors = clumps(3, 24, 0.2, [60, 30, 5, 2, *[1] * 80])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(500 + i, vectors[0].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found_links(df, bucket_vectors=40, block_vectors=block)
    assert by_text(got) == by_text(plain_links(rows))
    assert max(n for _, n, _ in got) >= 90  # copies of a clump's vector link with it all


def test_recall_at_the_threshold_itself():
    code = caps.ProductCode(48, 8, 0.9, 0.999)
    rng = np.random.default_rng(9)
    x = caps.unit(rng.normal(size=(2000, 48)))
    y = rng.normal(size=x.shape)
    y = 0.9 * x + np.sqrt(1 - 0.81) * caps.unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    shared = set(zip(*code.decode(x))) & set(zip(*code.decode(y)))
    assert len({row for row, _ in shared}) >= 0.99 * len(x)


def test_decoded_filters_are_all_that_exceed():
    code = caps.ProductCode(10, 7, 0.9, 0.99)
    x = caps.unit(np.random.default_rng(2).normal(size=(30, 10)))
    owner, found = code.decode(x)
    words = code.words[:, :, :10]
    want = [
        (r, (c * 7 + i) * 7 + j)
        for r in range(30)
        for c in range(code.codes)
        for i in range(7)
        for j in range(7)
        if x[r] @ words[c, i] + x[r] @ words[c, 7 + j] >= code.bound
    ]
    assert list(zip(owner.tolist(), found.tolist())) == want
    turned = code.words[0].reshape(14, -1)
    assert np.allclose(turned[:7] @ turned[7:].T, 0) and np.allclose((turned**2).sum(axis=1), 1)


def test_close_calls_are_settled_alike():
    a = np.array([[0.9, np.sqrt(1 - 0.81)], [0.9 - 1e-12, np.sqrt(1 - (0.9 - 1e-12) ** 2)]])
    assert caps._cosines(a, np.array([[1.0, 0.0]]), 0.9)[:, 0].tolist() == [True, False]


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0]), (2, [1e300, 1e299]), (3, [1e-300, 1e-301]), (3, [0.0, -1.0]), (None, [0.0, -2.0]),
        (4, None), (5, []), (6, [0.0, 0.0]), (7, [inf, 1.0]), (8, [nan, 1.0]), (9, [None, 1.0]),
        (10, [1.0, 0.0, 0.0]), (None, [-1.0, 0.0]), (None, None), (11, [2.0]), (12, [0.5]), (1, [1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.withColumns({c: F.lit("x") for c in ("uid", "bucket", "a", "copies", "__own", "component")})
    got = found_links(df)
    assert by_text(got) == by_text(plain_links(rows))
    assert found_links(df.limit(0)) == []


# --- 12: spelling variants ---------------------------------------------------------------------


def plain_spelling(docs: list[tuple]) -> set[tuple]:
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{' ' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    near, shorter = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1 :]].add(w)
    for short, words in shorter.items():
        if short in counts:
            near[short] |= words
            for w in words:
                near[w].add(short)
        for a, b in itertools.permutations(words, 2):
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
                near[a].add(b)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


def found_spelling(df, **kw) -> set[tuple]:
    got = spelling.spelling_groups(df, **kw)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_spelling_query_matches_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    got = {tuple(r) for r in queries.QUERIES["op12_frequency_trie"](spark, SF).collect()}
    want = plain_spelling(list(docs.itertuples(index=False, name=None)))
    assert got == want and any(form for _, form, *_ in want)


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(4)
    letters = "abcdeghiprsé×Àÿ"
    stems = ["".join(rng.choices(letters, k=rng.randrange(7, 11))) for _ in range(12)] + ["a" * 9, "ab" * 40]
    docs = []
    for stem in stems:
        words = [stem] * 400
        for _ in range(40):
            w = list(stem)
            for _ in range(rng.randrange(1, 3)):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1, 1])] = rng.choice(["", *letters])
            words += ["".join(w)] * rng.choice([1, 2, 3, 30])
        docs.append(" ".join(words))
    return [(i, t) for i, t in enumerate(docs)] + [(0, docs[0]), (None, docs[1]), (90, None), (91, ""), (92, "a" * 700)]


@pytest.mark.parametrize("kw", [{}, {"block_words": 5, "trie_words": 40}, {"trie_words": 1}])
def test_variants_in_whole_and_divided_groups(spark, misspelt, kw):
    df = spark.createDataFrame(misspelt, "doc_id long, text string")
    df = df.withColumns({c: F.lit("x") for c in ("word", "n", "id", "run", "__own", "counts")})
    got = found_spelling(df, **kw)
    assert got == plain_spelling(misspelt)
    assert any(root not in (form, word) for word, form, root, *_ in got)  # a chain
    assert not found_spelling(df.limit(0))


def test_word_of_a_long_text(spark):
    text = "zebrastripe " * 100_000 + "q" * 300_000 + " " + ("q" * 299_999 + " ") * 2 + "q" * 300_000
    got = {w: (n, near) for w, _, _, n, near, _ in found_spelling(spark.createDataFrame([(7, text)], "doc_id long, text string"))}
    assert got["zebrastripe"] == (100_000, 0) or len(got) > 2  # unless the checksum took a letter
    assert got["q" * 300_000][1] == got["q" * 299_999][1] == 1 or zlib.crc32(("7:" + "q" * 300_000).encode()) % 31 == 0


def test_one_edit_apart_and_the_verifier_agree():
    rng = random.Random(8)
    words = ["".join(rng.choices("ab", k=rng.randrange(7, 11))) for _ in range(60)]
    words += ["a" * 47, "a" * 48, "a" * 49, "a" * 50, "a" * 48 + "b", "b" + "a" * 48]
    import pyarrow as pa

    verify = spelling.Verifier(*spelling.letters(pa.array(words)))
    a, b = (x.ravel() for x in np.indices((len(words), len(words))))

    def plain(x, y):
        def less(s):
            return {s[:i] + s[i + 1 :] for i in range(len(s))}

        return x != y and (x in less(y) or y in less(x) or (len(x) == len(y) and sum(p != q for p, q in zip(x, y)) == 1))

    want = [plain(words[i], words[j]) for i, j in zip(a, b)]
    assert verify.near(a, b).tolist() == want
    assert [spelling.one_edit_apart(words[i], words[j]) for i, j in zip(a, b)] == want


# --- 13: conversations -------------------------------------------------------------------------


def plain_plan(rows: tuple) -> tuple[int, str]:
    """(cost, audit) for rows of (first letter of the role, fault), by trying all."""

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "")] if i == len(rows) and state in "-a" else []
        after = "a" if state == "u" else "u"
        if inserted < 3:
            cost, audit = best(i, after, inserted + 1)
            ways.append((cost + 3, "I" + audit))
        if i < len(rows):
            letter, fault = rows[i]
            cost, audit = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (state + letter) in ("-s", "-u", "su", "au", "ua"):
                    cost, audit = best(i + 1, letter, 0)
                    ways.append((cost + more, "K" + audit))
                cost, audit = best(i + 1, after, 0)
                ways.append((cost + 3 + more, "R" + audit))
        return min(ways, default=(10**9, ""))

    return best(0, "-", 0)


def plain_repair(conversations: list[tuple]) -> dict:
    """By conversation, from (conv, turn, role, text, present)."""
    out = {}
    groups = defaultdict(list)
    for conv, turn, role, text, present in conversations:
        groups[conv] += [(turn, role, text)] if present else []
    for conv, rows in groups.items():
        def place(row):
            turn, role, text = row
            both = f"{len(role.encode())}:{role}{text}".encode()
            return turn is not None, turn or 0, hashlib.md5(both).digest()

        rows.sort(key=place)
        seen, kinds = set(), []
        for _, role, text in rows:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else ""
            fault = fault or ("truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
            kinds.append((role[:1], fault))
        cost, audit = plain_plan(tuple(kinds))
        lines, state, todo = [], "-", iter(rows)
        for edit in audit:
            role = "assistant" if state == "u" else "user"
            text = ""
            if edit != "I":
                _, own, text = next(todo)
                role = own if edit == "K" else role
            if edit != "D":
                lines.append(f"{role}:{text}")
                state = role[0]
        turns = {t for t, _, _ in rows if t is not None}
        faults = [f for _, f in kinds]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(kinds)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        lot = zlib.crc32(name.encode()) % 20
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text, lot != 0)] * (2 if lot == 3 else 1)
    return out


CHOICES = ["The end.", "What?", "cut off", "", " \t", "The end. \n", "No!", "\x1f"]


def odd_conversations(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "sage"]
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.choice([1, 2, 3, 5, 8, 30])):
            turn = rng.choice([None, *range(9), *range(9)])
            rows.append((conv, turn, rng.choice(roles), rng.choice([*CHOICES, None])))
    return rows + rows[:20]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_query_matches_plain_version(spark):
    data = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in data.select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op13_hirschberg_repair"](spark, SF).collect()}
    assert got == plain_repair(damage(rows))


def test_repair_of_odd_conversations(spark):
    rows = odd_conversations(5, 150)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "plan", "edit", "fault", "first")})
    got = repair.repair_conversations(repair.damaged(df), present_col="present").collect()
    assert len(got) == 151
    assert {r[0]: tuple(r)[1:] for r in got} == plain_repair(damage(rows))
    empty = repair.repair_conversations(df.limit(0))
    assert empty.count() == 0 and empty.columns[0] == "conv_id" and empty.columns[-1] == "repaired_sha256"


def test_repaired_turns_are_what_is_hashed(spark):
    rows = [(c, t, r, x) for c, t, r, x in odd_conversations(6, 40) if c is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in repair.repair_conversations(df).collect()}
    lines = defaultdict(list)
    for r in sorted(repair.repaired_turns(df).collect(), key=lambda r: (r["conv_id"], r["place"])):
        assert r["place"] == len(lines[r["conv_id"]])
        lines[r["conv_id"]].append((r["role"], r["text"]))
    for conv, digest in digests.items():
        letters = "".join(role[0] for role, _ in lines[conv])
        assert re.fullmatch("(s?(ua)+)?", letters)
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines[conv]).encode()).hexdigest() == digest


def test_conversation_with_no_rows_left(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", False)], SCHEMA + ", present boolean")
    row = repair.repair_conversations(df, present_col="present").first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_plans_are_the_cheapest_and_least():
    planner = repair.Planner()
    faults = ["", "blank", "duplicate", "truncated"]
    kinds = [(letter, f) for letter in "suax" for f in range(4)]
    rng = random.Random(1)
    cases = [c for n in range(4) for c in itertools.product(kinds, repeat=n)]
    cases += [tuple(rng.choices(kinds, k=rng.randrange(4, 70))) for _ in range(600)]
    for rows in cases:
        coded = bytes(f * 4 + "suax".index(letter) for letter, f in rows)
        audit = planner.audit(coded)
        want = plain_plan(tuple((letter, faults[f]) for letter, f in rows))
        assert (repair.audit_cost(coded, audit), audit) == want


def test_long_conversation_and_long_text(spark):
    n = 30_000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(n)]
    rows[100] = (1, 100, "user", "x" * 2_000_000 + ".")
    row = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    whole = "\n".join(f"{r}:{t}" for _, _, r, t in rows)
    assert row["audit"] == "K" * n and row["repaired_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
