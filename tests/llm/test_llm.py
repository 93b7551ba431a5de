import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.llm import conversations, entities, garbled, history, mixing, packing, residue, sentences, tokens
from lorewell.llm.graph import components

CLEAN = "Zítra se sejdeme na nádraží a Květa přinese dárek, příště to bude lepší. Přemek říkal, že už jede. Není to možné? Для меня это хорошо, спасибо большое não amanhã. AMANHÃ NÃO!".split()


def model(extra=()):
    import re
    import zlib

    counts = np.zeros(garbled.BUCKETS, dtype="float32")
    for w in [*CLEAN * 50, *extra]:
        for t in garbled._TOKEN.findall(w.lower()):
            x = f"^{t}$"
            for i in range(len(x) - 2):
                counts[zlib.crc32(x[i : i + 3].encode("utf-8", "surrogatepass")) & (garbled.BUCKETS - 1)] += 1
    assert re
    return counts


@pytest.fixture(scope="module")
def restorer():
    return garbled.Restorer(garbled.LetterModel(model()))


# --- p2


@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac-roman"])
@pytest.mark.parametrize("word", ["přinese", "nádraží", "příště", "říkal"])
def test_utf8_round_trip(restorer, codec, word):
    raw = word.encode("utf-8")
    try:
        bad = raw.decode(codec)
    except UnicodeDecodeError:
        bad = "".join(c if (c := garbled._chars(codec)[b - 128] if b > 127 else chr(b)) else "" for b in raw)
    out, pair = restorer.restore(f"on {bad} to")
    assert pair and out == f"on {word} to"


def test_garbled_cases(restorer):
    twice = "příště".encode().decode("latin-1").encode("utf-8").decode("latin-1")
    assert restorer.restore(twice)[0] == "příště"
    assert restorer.restore("příště".encode("cp1250").decode("latin-1"))[0] == "příště"
    assert restorer.restore("хорошо".encode("cp1251").decode("latin-1"))[0] == "хорошо"
    out, pair = restorer.restore("p&Aring;&#153;inese &amp; ano")
    assert out == "přinese &amp; ano" and pair.startswith("utf-8 as")
    assert restorer.restore("p\\u00c5\\u0099inese")[0] == "přinese"
    assert restorer.restore("Kv�ta")[1] == "replaced"
    typed = "napsal jsem &eacute; a \\u00e9 schválně, ale pÅ™inese"
    assert restorer.restore(typed)[0] == typed.replace("pÅ™inese", "přinese")
    deep = "příště"
    for _ in range(7):
        deep = deep.encode("utf-8").decode("latin-1")
    assert restorer.restore(deep)[0] == "příště"
    mixed = "správně a pÅ™inese"
    assert restorer.restore(mixed)[0] == "správně a přinese"
    for fine in (None, "", "plain", "Zítra přinese dárek", "på søndag rødgrød", "NÃO, AMANHÃ!", "«ça va ?»", "½ litru", "США», ok", "😀👍"):
        assert restorer.restore(fine) == (fine, None)


def test_garbled_frame(spark):
    rows = [(i, w, "x") for i, w in enumerate([*CLEAN * 20, "pÅ™inese", None, "", "a" * 50_000 + " pÅ™inese", "pÅ™inese"])]
    df = spark.createDataFrame(rows, "row_id bigint, text string, r string")
    counts = spark.sparkContext.broadcast(garbled.fit_letters(df.select("text")))
    out = garbled.find_garbled(df, "row_id", "text", counts).collect()
    n = len(CLEAN) * 20
    assert {r["record_id"] for r in out} == {n, n + 3, n + 4}
    assert all(r["restored"].endswith("přinese") for r in out)
    assert garbled.find_garbled(df.limit(0), "row_id", "text", counts).count() == 0


# --- p3


def account(i, platform, name, shown=None, person=None, avatar=None):
    return (i, name, shown, None, None, platform, person, avatar, "extra")


USERS = "id bigint, name string, display_name string, avatar_url string, discriminator string, platform string, person_id bigint, avatar_sha256 string, key string"


def test_entities(spark):
    rows = []
    firsts = ["Radovan", "Květoslava", "Noémie", "Jörn", "Ferris", "Tilda"]
    rng = random.Random(1)
    for k in range(60):
        first, last = firsts[k % 6], "".join(rng.choice(["ku", "ra", "mi", "zo", "te", "ba", "lo", "ni"]) for _ in range(4)).capitalize() + "řil"
        plain = entities.folded(last)
        rows += [account(4 * k + 1, "facebook", f"{first} {last}"), account(4 * k + 2, "teams", f"{last}, {first}"), account(4 * k + 3, "instagram", f"{entities.folded(first)}.{plain}", first)]
        rows.append(account(4 * k + 4, "discord", f"{entities.folded(first)[0]}{plain}{k + 10}", None))
    rows += [account(9001, "facebook", None), account(9002, "teams", "", ""), rows[0]]
    users = spark.createDataFrame(rows, USERS)
    counts = spark.sparkContext.broadcast(np.zeros(garbled.BUCKETS, dtype="float32"))
    got = {(r["user_id_a"], r["user_id_b"]) for r in entities.linked(entities.matched(users, counts), users).collect()}
    true = {(4 * k + a, 4 * k + b) for k in range(60) for a in range(1, 5) for b in range(a + 1, 5)}
    assert len(got & true) / len(true) > 0.9
    assert len(got & true) / len(got) > 0.95
    none = users.limit(0)
    assert entities.linked(entities.matched(none, counts), none).count() == 0


def wanted_pairs(spark, rows):
    """The candidate pairs of (id, platform, family, given, handle)."""
    schema = "id bigint, platform string, person_id bigint, picture string, names array<struct<family:string,given:string>>, given string, handle string, digits string"
    accounts = [(i, p, None, None, [{"family": f, "given": g}] if f else [], g, h, "") for i, p, f, g, h in rows]
    return {tuple(r) for r in entities.paired(spark.createDataFrame(accounts, schema)).collect()}


def test_large_blocks_are_compared_whole(spark):
    rows = [(i, "ab"[i % 2], "novak", "cdefgh"[i % 6] + "ana", "") for i in range(2 * entities.BLOCK + 7)]
    n = len(rows)
    rows += [(n, "c", "novak", "bob", ""), (n + 1, "d", "novak", "robert", ""), (n + 2, "e", "", "", "novak")]
    got = wanted_pairs(spark, rows)
    might = lambda a, b: not a[3] or not b[3] or entities._given_alike(a[3], b[3]) > 0
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and might(a, b)}
    assert want <= got and (n, n + 1) in got and all((i, n + 2) in got for i in range(n + 2))
    assert (0, n + 1) not in got  # given names with nothing in common don't meet


@given(st.text("abcde", min_size=1, max_size=9), st.text("abcde", min_size=1, max_size=9))
@settings(max_examples=300, deadline=None)
def test_like_given_names_share_a_tag(a, b):
    for x, y in ((a, b), (a, a[:3]), (a, a[:-1] + "e"), (a, "x" + a[1:]), ("bob", "robert"), ("pepa", "josef")):
        if y and entities._given_alike(x, y) > 0.8 or (y and entities._given_alike(x, y) and len(x) > 3 and len(y) > 3):
            assert entities._given_tags(x) & entities._given_tags(y), (x, y)


def test_confidences_of_implied_pairs(spark):
    pairs = [(1, 2, "a", "b", None, [9, 9, 5, 5], 0.9), (2, 3, "b", "c", None, [9, 9, 5, 5], 0.8), (3, 4, "c", "d", None, [9, 9, 5, 5], 0.7), (5, 6, "a", "b", 0.0, [9, 9, 5, 5], 0.0)]
    scored = spark.createDataFrame(pairs, "a bigint, b bigint, pa string, pb string, known double, v array<int>, posterior double")
    users = spark.createDataFrame([(i, p) for i, p in enumerate("?abcdab")], "id bigint, platform string")
    got = {(r[0], r[1]): round(r[2], 6) for r in entities.linked(scored, users).collect()}
    assert got == {(1, 2): 0.9, (2, 3): 0.8, (3, 4): 0.7, (1, 3): 0.72, (2, 4): 0.56, (1, 4): 0.504}


def test_long_handles_are_cut_whole(spark):
    rows = [(1, "a", "", "", "friederikerimetinsky"), (2, "b", "rimetinski", "friederike", ""), (3, "a", "", "", "abcdefghjanlmnovakxyzuvw"), (4, "b", "novak", "jan", "")]
    assert wanted_pairs(spark, rows) == {(1, 2), (3, 4)}


def test_like_names_meet(spark):
    rows = [(1, "a", "li", "kim", ""), (2, "b", "li", "kim", ""), (3, "c", "", "", "kimli"), (4, "a", "nagy", "ajna", ""), (5, "b", "nagy", "jana", ""), (6, "c", "", "", "jnagy"), (7, "a", "novak", "eva", ""), (8, "b", "nowak", "eva", ""), (9, "a", "", "", "krugudochaby"), (10, "b", "krugudocha", "byron", ""), (11, "a", "", "", "eva.nwoak")]
    rng = random.Random(5)
    for i in range(100, 260, 4):
        family, first = ("".join(rng.choice(["ku", "ra", "mi", "zo", "te"]) for _ in range(rng.randint(2, 5))) for _ in "ab")
        wrong = lambda w, at: w[:at] + rng.choice(["", "x", w[at + 1 : at + 2] + w[at : at + 1], w[at : at + 1] + "q"]) + w[at + (2 if w[at + 1 :] and rng.random() < 0.3 else 1) :]
        rows += [(i, "a", family, first, ""), (i + 1, "b", wrong(wrong(family, 1), len(family) // 2), first, ""), (i + 2, "c", "", "", wrong(family, rng.randrange(len(family))) + first[0]), (i + 3, "d", "", "", first + wrong(family, 2))]
    got = wanted_pairs(spark, rows)
    assert {(1, 2), (1, 3), (2, 3), (4, 5), (5, 6), (7, 8), (8, 11), (9, 10)} <= got
    side = lambda r: (None, [{"family": r[2], "given": r[3]}] if r[2] else [], r[3], r[4], "")
    for k, a in enumerate(rows):
        for b in rows[k + 1 :]:
            once = bool(a[2]) == bool(b[2]) or entities._less(a[2] + b[2], 1) & entities._stretches((a[4] + b[4]).replace(".", ""))
            v = entities.vector(side(a), side(b))
            if a[1] != b[1] and round(v[0] * entities.GRID) >= entities.LEAST and v[1] > 0.5 and once:
                assert (a[0], b[0]) in got, (a, b, v)


def test_edits_by_bits_and_by_cells():
    rng = random.Random(3)
    for _ in range(5000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(1, 11))) for _ in "ab")
        assert entities._alike(a, b) == entities._alike_cells(a, b)


def test_many_pairs_side_by_side():
    rng = random.Random(4)
    word = lambda most, letters="abcd": "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    pairs = [(word(12), word(12, "abcd�" if i % 9 == 0 else "abcd")) for i in range(4000)] + [("ab" * 40, "ab" * 39)]
    assert entities._alike_all(pairs) == [entities._alike(*p) for p in pairs] and entities._alike_all([]) == []
    held = [p for p in pairs if p[1]]
    assert entities._placed_all(held) == [entities._placed(*p) for p in held]
    sides = [(rng.choice([None, "p1", "p2"]), [{"family": word(9) or "a", "given": word(5)} for _ in range(rng.randint(0, 2))], word(5), word(14, "abcd._"), rng.choice(["", "12"])) for _ in range(300)]
    told = [(p or "", n := [(x["family"], x["given"]) for x in names], g, h, d, entities._foreign(n, h)) for p, names, g, h, d in sides]
    assert entities.vectors(list(zip(told, told[1:]))) == [entities.vector(a, b) for a, b in zip(sides, sides[1:])]


def test_short_tables_are_spread_and_marked(spark):
    words = [f"w{i}" for i in range(3000)] + ["no�ak"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert entities._spread(rows, "w").distinct().select(F.spark_partition_id()).distinct().count() == parts
    bits = entities._marks(rows)
    has = lambda w: bits[(k := crc32(w.encode()) % entities.MARKS) >> 3] >> (k & 7) & 1
    assert len(bits) == entities.MARKS >> 3 and all(map(has, words))
    assert sum(has(f"x{i}") for i in range(3000)) < 10
    assert not any(entities._marks(rows.limit(0)))


def test_given_names():
    assert entities._given_alike("eli", "eliska") == 0.8
    assert entities._given_alike("e", "eliska") == 0.7
    assert entities._given_alike("radovan", "eliska") == 0.0
    assert entities.folded("Цтирад Łucja") == "ctirad lucja"
    assert entities.parts_of("Ing. Begoña B. (Ext)") == ["begona", "b"]


# --- p4

MESSAGES = "row_id bigint, run_id bigint, channel_id bigint, sender_id bigint, message_id bigint, source_key string, timestamp bigint, text string, key string"
T = 1_600_000_000_000


def brute_repeats(rows, norm):
    seen = {r[0]: r for r in rows if r[2] is not None and r[3] is not None}
    parent = {i: i for i in seen}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(seen)
    for x in range(len(ids)):
        for y in range(x):
            a, b = seen[ids[x]], seen[ids[y]]
            if a[2:4] != b[2:4]:
                continue
            gap = abs(a[6] - b[6]) if a[6] is not None and b[6] is not None else None
            (wa, da), (wb, db) = norm(a[7]), norm(b[7])
            same = (a[4] is not None and a[4] == b[4]) or (a[5] is not None and a[5] == b[5])
            if gap is not None:
                same |= gap <= 2000 and history.same_text(wa, wb, da or db)
                same |= gap % 3_600_000 == 0 and gap < 86_400_000 and a[7] is not None and a[7] == b[7]
            if same:
                parent[root(ids[x])] = root(ids[y])
    groups = {}
    for i in ids:
        groups.setdefault(root(i), []).append(i)
    out = set()
    for g in groups.values():
        first = min(g, key=lambda i: (seen[i][1], i))
        out |= {(first, i) for i in g if i != first}
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["to je skvělé", "Řidič č. 37 čekal přes hodinu", "track 1 done", "track 2 done", "ok", "", None, "Meet me at the café at 7:00 sharp"]
    rows = []
    for i in range(160):
        t = rng.choice(texts)
        rows.append((i, rng.randint(1, 4), rng.choice([1, 2]), rng.choice([7, 8]), rng.choice([None, i, i, i // 3]), rng.choice([None, f"k{i // 2}"]), T + rng.choice([0, 1500, 3_600_000, 59_500, 86_400_000]) + rng.randint(0, 3) * 1000, t, "x"))
    rows += [(900, 4, 1, 7, 900, None, T + 10, "<b>To je   SKVELE!</b> 😀", "x"), (901, 4, 1, 7, 901, None, None, "to je skvělé", "x"), (902, 4, None, 7, 1, None, T, "ok", "x")]
    df = spark.createDataFrame(rows, MESSAGES)
    history_model = lambda *_: model()
    norm = history.Normaliser(garbled.Restorer(garbled.LetterModel(model())))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(history.History, "letters", history_model)
        patch.setattr(history, "FAN", 2)  # segments are merged, too
        got = {tuple(r) for r in history.repeats(df, [[1], [2, 3], [4]], parts=4).collect()}
    assert got == brute_repeats(rows, norm)
    assert history.repeats(df.limit(0), [], parts=4).count() == 0
    assert history.repeats(df.limit(0), [[1], [2]], parts=4).count() == 0


def test_many_copies_cost_no_pairs(spark):
    df = spark.range(20_000).select(F.col("id").alias("row_id"), F.lit(1).alias("run_id"), F.lit(1).alias("channel_id"), F.lit(2).alias("sender_id"), F.lit(3).alias("message_id"), F.lit("k").alias("source_key"), F.lit(T).alias("timestamp"), F.lit("copy").alias("text"))
    out = history.repeats(df, [[1]], parts=4)
    assert out.agg(F.count("*"), F.min("row_id_a"), F.max("row_id_a")).first() == (19_999, 0, 0)


def batch_of(spark, run, n, again=()):
    rows = [(run * 100_000 + i, run, 1, i % 50, run * 100_000 + i, None, T + run * 86_400_000 + i * 60_000, f"message {run} number {i} of the day", "x") for i in range(n)]
    rows += [(run * 100_000 + 90_000 + k, run, 1, i % 50, old * 100_000 + i, None, T, "anything", "x") for k, (old, i) in enumerate(again)]
    return spark.createDataFrame(rows, MESSAGES)


def test_a_ninth_batch_in_a_new_session(spark, tmp_path):
    root, read = str(tmp_path / "state"), []
    for run in range(1, 9):
        store = history.History(spark, root, 4, 64)  # opened again each time
        store.append(batch_of(spark, run, 600))
        read.append(store.read_rows)
    assert len(store.state["prints"]) == 8 and store.state["batches"] == 8
    late = history.History(spark, root)
    links = {(r["a_row"], r["b_row"]) for r in late.append(batch_of(spark, 9, 600, [(1, 7), (8, 5)])).collect()}
    assert links == {(100_007, 990_000), (800_005, 990_001)}
    assert [level for level, _ in late.state["prints"]] == [1, 0]  # eight segments became one
    # nothing of the history is read but the row groups of positives: a few false ones, however long the history is
    assert late.read_rows <= 4 * max(read) + 20 * 64 and late.read_rows < 600 * 9 * 3 / 4
    assert {tuple(r) for r in late.repeats().collect()} == links
    (tmp_path / "state" / "manifest-10.json").write_text("{}")
    with pytest.raises(RuntimeError):
        late.append(batch_of(spark, 10, 5))


def test_same_text():
    same = history.same_text
    assert same("prijdu za chvili", "prijdu za cvhili") and same("meet me at the cafe no later", "meet me at the ca")
    assert not same("track 1 done", "track 2 done") and not same("see you soon", "see him soon") and not same("muito obrigado", "muito obrigado \x01 sorry typo")
    assert same("", "") and not same("", "a") and same("al�b�ta", "alzbeta", True)


@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=200, unique=True))
@settings(max_examples=50, deadline=None)
def test_bloom_has_no_false_negatives(keys):
    k = np.array(sorted(keys), dtype=np.int64)
    assert history.bloom_has(history.bloom_of(k), k).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 9)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8}
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(chain).agg(F.max("root"), F.count("*")).first() == (0, 301)
    assert components(chain.limit(0)).count() == 0


# --- p5


def best_parent(rows, k, names, counts):
    """The best parent by comparing a row with all rows before it."""
    ts, row, sender, text = rows[k]
    words = set(conversations._TOKEN.findall(text.lower()))
    scan, best = conversations._Scan(counts), None
    for i in range(k - 1, -1, -1):
        t, r, s, said = rows[i]
        time = scan._time(ts - t)
        if i == k - 1:
            best = (time + (conversations.TURN if s != sender else 0.0), r)
        if s == sender:
            continue
        gains = [conversations.WORD * scan._rarity(w) for w in words & set(conversations._TOKEN.findall(said.lower()))]
        if names[s] in words and not any(x[2] == s for x in rows[i + 1 : k]):
            gains.append(conversations.MENTION)
        score = time + conversations.TURN + max(gains, default=-99.0)
        if score >= conversations.ROOT_BELOW and score > best[0]:
            best = (score, r)
    return best


def test_old_messages_are_answered(spark):
    rng = random.Random(5)
    names = {1: "anna", 2: "boris", 3: "cyril"}
    vocabulary = [f"word{i}" for i in range(60)] + list(names.values())
    ts, rows = 1_600_000_000_000, []
    for r in range(300):
        ts += int(rng.choice([60_000, 3_600_000, 86_400_000, 9 * 86_400_000]) * rng.uniform(0.2, 2))
        rows.append((ts, r, rng.choice([1, 1, 2, 3]), " ".join(rng.sample(vocabulary, 3))))
    counts = np.full(conversations.BUCKETS + 1, 3, dtype="float32")
    counts[-1] = 50_000
    frame = spark.createDataFrame([(7, r, s, t, x) for t, r, s, x in rows], "channel_id bigint, row_id bigint, sender_id bigint, ts bigint, text string")
    users = spark.createDataFrame([(i, n, None) for i, n in names.items()], "id bigint, name string, display_name string")
    got = {r["row_id"]: r for r in conversations.links(frame, users, spark.sparkContext.broadcast(counts)).collect()}
    assert len(got) == len(rows)
    for k in range(1, len(rows)):
        score, parent = best_parent(rows, k, names, counts)
        assert got[k]["parent_row"] == parent and abs(got[k]["score"] - score) < 1e-9, rows[k]
    assert sum(r["ts"] - r["parent_ts"] > 86_400_000 and r["parent_row"] != r["row_id"] - 1 for r in got.values() if r["parent_row"] is not None) > 20


def test_roots_of_trees(spark):
    rng = random.Random(8)
    week, rows, parent = conversations.SLAB_MS, [], {}
    for r in range(400):
        parent[r] = rng.choice([None, *range(max(0, r - 40), r)]) if r else None
        rows.append((1, r, 5 * week + r * week // 30, parent[r]))
    top = lambda r: r if parent[r] is None else top(parent[r])
    frame = spark.createDataFrame(rows, "channel_id bigint, row_id bigint, ts bigint, parent_row bigint")
    assert {r["row_id"]: r["root"] for r in conversations.tree_roots(frame).collect()} == {r: top(r) for r in range(400)}
    assert conversations.tree_roots(frame.limit(0)).count() == 0


def test_conversations(spark):
    users = spark.createDataFrame([(1, "Jana Nováková", None, None), (2, "Petr Malý", None, 1), (3, "Eva", None, None)], "id bigint, name string, display_name string, person_id bigint")
    channels = spark.createDataFrame([(c,) for c in (10, 11, 12, 13, 14, 15, 16)], "id bigint")
    people = spark.createDataFrame([(1, 1)], "person_id bigint, is_self int")
    m = lambda r, c, s, ts, t, u=0: (r, 1, c, s, r, ts, t, u, "x")
    rows = [
        m(1, 10, 1, T, "kdo má stan?"), m(2, 10, 2, T + 1000, "já ne"), m(3, 10, 3, T + 2000, "stan mám, Jana"), m(4, 10, 1, T + 9 * 86_400_000, "po týdnu"),
        m(5, 11, 1, T, "sám"), m(6, 11, 1, T + 1, "pořád sám"), m(7, 11, 2, T + 2, "​ \n"), m(8, 11, 2, T + 3, "nic", 1),
        m(9, 12, None, T, "x"), m(10, 12, 1, T, "y"), m(11, 13, 1, None, "x"), m(12, 14, 99, T, "x"), m(13, 15, 1, T, ""), m(14, 15, 2, T, None),
    ]
    messages = spark.createDataFrame(rows, "row_id bigint, run_id bigint, channel_id bigint, sender_id bigint, message_id bigint, timestamp bigint, text string, is_unsent int, name string")
    links, verdicts = conversations.rebuild(messages, users, channels)
    assert {r["channel_id"]: r["verdict"] for r in verdicts.collect()} == {10: None, 11: "no replies", 12: "broken", 13: "broken", 14: "broken", 15: "empty", 16: "empty"}
    parent = {r["row_id"]: r["parent_row"] for r in links.where("channel_id = 10").collect()}
    assert parent[1] is None and parent[2] == 1 and parent[3] == 1 and parent[4] == 3
    out = {r["row_id"]: r for r in conversations.turns(messages, users, people, channels).collect()}
    assert set(out) == {1, 2, 3, 4} and out[2]["role"] == "owner" and out[1]["role"] == "other"
    assert out[3]["conversation_row"] == 1 and out[4]["conversation_row"] == 4
    replies = spark.createDataFrame([(4, 2), (3, 77)], "message_id bigint, replied_to_id bigint")
    assert {r["row_id"]: r["parent_row"] for r in conversations.turns(messages, users, people, channels, replies).collect()}[4] == 2
    _, none = conversations.rebuild(messages.limit(0), users, channels)
    assert none.where("verdict = 'empty'").count() == 7


# --- p6


@pytest.mark.parametrize("text,kind", [
    ("Hi {{name}}, your invitation is waiting", "placeholder"), ("Dear %(name)s,\nwe noticed", "placeholder"), ("[object Object] has joined", "placeholder"), ("Reminder: NaN starts at undefined", "placeholder"), ("Kdo má ${first_name}?", "placeholder"),
    ("Lorem ipsum dolor sit amet nulla", "filler"), ("xxx DOPLNIT xxx", "filler"), ("TODO: write the announcement", "filler"), ("Insira o texto aqui", "filler"),
    ("404 Not Found", "error"), ("Fehler 502\npožadovaná stránka neexistuje. Request 9.", "error"), ("<h1>Oops: the requested page does not exist</h1>", "error"), ("Traceback (most recent call last): x", "error"), ("Hoppla! the server did not answer in time. Zpět na úvod", "error"), ("[Preview] Error 9841: the page you requested could not be found", "error"),
    ("Please enable JavaScript to view this message.", "script"), ("Включите JavaScript, чтобы продолжить", "script"), ("Pro zobrazení obsahu zapněte JavaScript.", "script"), ("JavaScript is disabled in your browser. Turn it on and reload.", "script"),
])
def test_residue(text, kind):
    found, _, firm = residue.evidence(text)
    assert (found, firm) == (kind, True)
    assert residue.evidence(text.upper())[0] == kind


@pytest.mark.parametrize("text", [
    "", "   ", "ahoj", "the template wants `{{name}}` in the first line", "use ${HOME}/photos as the path", "page not found? try without the www", "error 503 again all morning, going for coffee",
    "my javascript course starts at the pier", "warum will die seite immer cookies und javascript?", "napsala jsem TODO list: stan", "set {d, e} has two elements, right?", "I got a 404 on that page too, lol", "the server did not answer, so we left without paying", "session has expired on my phone as well", "100 % jistě",
])
def test_no_residue(text):
    assert residue.evidence(text)[0] is None


def test_residue_frames_and_boilerplate(spark):
    rows = [(1, "a", "null has joined the group"), (2, "a", "{{x}} has joined the group"), (3, "b", "null points for Brynn"), (4, None, "Hi {{n}}!"), (5, "a", None), (6, "a", "")]
    rows += [(10 + i, "a", f"zpráva {'abcdefgh'[i]}\nPlease enable JavaScript to see the footer") for i in range(6)]
    rows += [(20, "a", "Please enable JavaScript to see the footer")]
    df = spark.createDataFrame([(r, h, t, "x") for r, h, t in rows], "row_id bigint, host string, text string, line string")
    counts = spark.sparkContext.broadcast(np.zeros(garbled.BUCKETS, dtype="float32"))
    got = {r["row_id"] for r in residue.judged(df.where("text IS NOT NULL"), counts).collect()}
    assert got == {1, 2, 4, 20}
    assert residue.judged(df.limit(0), counts).count() == 0


def test_boilerplate_is_counted_over_all_records(spark):
    footer = "-- gesendet von unterwegs"
    rows = [(i, "p", f"bis morgen {w}\n{footer}") for i, w in enumerate(["anna", "boris", "cyril", "dana"])]
    rows += [(10, "p", f"tbd\n{footer}"), (11, "q", f"tbd\n{footer}")]
    frame = spark.createDataFrame(rows, "row_id bigint, host string, text string")
    counts = spark.sparkContext.broadcast(model())
    assert [tuple(r) for r in residue.judged(frame, counts).collect()] == [(10, "filler")]


def test_every_record_is_looked_at(spark):
    texts = ["Can we move __event.title__ forward?", "<% name %>, your seat is kept", "Hi ｛name｝", "<name1> has joined", "Blindtext", "クッキーを有効にしてください".replace("クッキー", "脚本"), "Zde\u00a0bude\u00a0text", "we met at the pier"]
    frame = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "row_id bigint, host string, text string")
    got = {r["row_id"] for r in residue.judged(frame, spark.sparkContext.broadcast(model())).collect()}
    assert got == {i for i, t in enumerate(texts) if residue.evidence(t)[2]} == set(range(7))


# --- p7, p8


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=12))
@settings(max_examples=25, deadline=None)
def test_plan_packs_everything(histogram):
    plan = packing.plan(histogram, 64)
    used = Counter()
    for pattern, n in plan.patterns:
        assert sum(length * a for length, a in pattern) <= 64 and n > 0
        for length, a in pattern:
            used[length] += n * a
    assert dict(used) == histogram
    total = sum(k * v for k, v in histogram.items())
    longest = max(histogram)
    assert plan.containers <= total / (64 - longest + 1) + len(histogram) + 1 if longest < 64 else True


def test_plan_is_tight():
    rng = random.Random(5)
    histogram = Counter(min(500, int(rng.expovariate(1 / 90)) + 5) for _ in range(20_000))
    plan = packing.plan(dict(histogram), 512)
    tokens_ = sum(k * v for k, v in histogram.items())
    assert tokens_ / 512 <= plan.bound <= plan.containers <= plan.bound * 1.005 + 1
    assert plan.rounded > 0.98 * 20_000  # the rounded solutions carry nearly all items,
    larger = packing.plan({k: 100 * v for k, v in histogram.items()}, 512)
    assert 2_000_000 - larger.rounded <= 400 and len(larger.patterns) < 4 * len(histogram)  # and what they leave doesn't grow with the items
    assert packing.plan({}, 10).containers == 0
    with pytest.raises(ValueError):
        packing.plan({1: 1}, 0)


def test_packed(spark):
    sizes = spark.createDataFrame([(i, n, 0) for i, n in enumerate([0, 5, 5, 7, 10, 25, 3, 20] * 30)], "doc_id bigint, tokens bigint, rank int").select("doc_id", "tokens")
    every = packing.packed(sizes, [("a", 10), ("b", 7), ("c", 1)]).collect()
    want = {r["doc_id"]: r["tokens"] for r in sizes.collect() if r["tokens"]}
    for name, capacity in (("a", 10), ("b", 7), ("c", 1)):
        room, pieces = Counter(), {}
        for r in every:
            if r["spec_name"] == name:
                room[r["container_id"]] += r["tokens"]
                pieces.setdefault(r["doc_id"], []).append((r["start_token"], r["tokens"]))
        assert max(room.values()) <= capacity and set(room) == set(range(len(room)))
        for d, n in want.items():
            own = sorted(pieces[d])
            assert sum(k for _, k in own) == n and all(a + k == b for (a, k), (b, _) in zip(own, own[1:])) and (n > capacity or len(own) == 1)
        assert set(pieces) == set(want)
    assert packing.packed(sizes.limit(0), [("a", 10)]).count() == 0
    assert packing.packed(sizes, []).count() == 0


def test_pack_requests(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").withColumn("capacity", F.lit("clash"))
    specs = spark.createDataFrame([("x", 64), (None, 32), ("none", None)], "spec_name string, capacity_tokens int")
    out = packing.pack(documents, specs)
    assert {r[0] for r in out.select("spec_name").distinct().collect()} == {"x", None}
    with pytest.raises(ValueError):
        packing.pack(documents, spark.createDataFrame([("x", 0)], "spec_name string, capacity_tokens int"))


def test_token_counts_agree(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("text").unionByName(spark.createDataFrame([("a" * 20_000,), (" " * 300,), ("<|endoftext|>",)], "text string"))
    both = texts.select(tokens.token_count(F.col("text")).alias("a"), tokens.token_count(F.col("text"), "/opt/tokenizers/byte_bpe_50k.json").alias("b"))
    assert both.where("a <> b").count() == 0


def test_ranked_in_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    out = tokens.ranked(df, ["g"], F.xxhash64("id"), per_task=300)
    for g in (0, 1):
        own = out.where(F.col("g") == g).orderBy("rank").select("rank", F.xxhash64("id").alias("h")).collect()
        assert [r["rank"] for r in own] == list(range(2500)) and [r["h"] for r in own] == sorted(r["h"] for r in own)


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), min_size=1, max_size=10), st.integers(0, 3000))
@settings(max_examples=60, deadline=None)
def test_fitted(counts, budget):
    got = mixing.fitted(counts, budget)
    total = sum(n * k for n, k in got.items())
    assert all(0 < k <= counts[n] for n, k in got.items()) and total <= max(budget, 0)
    if budget <= sum(n * c for n, c in counts.items()) and counts.get(1, 0) >= 60:
        assert total == budget


def test_fitting_long_documents_takes_little_memory():
    import tracemalloc

    rng = random.Random(2)
    counts = {rng.randint(1, 200_000): rng.randint(1, 3) for _ in range(1_500)}
    budget = sum(n * c for n, c in counts.items()) // 3
    tracemalloc.start()
    got = mixing.fitted(counts, budget)
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
    assert sum(n * k for n, k in got.items()) == budget and all(k <= counts[n] for n, k in got.items())


def test_mixed(spark, sf):
    documents, targets = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "mix_targets"))
    drawn = mixing.mixed(documents.withColumn("tokens", F.lit("clash")), targets).cache()
    limits = {(r["mix_name"], r["source"]): r["max_repeats"] for r in targets.collect()}
    assert all(0 < r["copies"] <= limits[r["mix_name"], r["source"]] for r in drawn.collect())
    shares = mixing.shares(drawn, targets).collect()
    assert len(shares) == targets.count()
    even = [r for r in shares if r["mix_name"] == "even"]
    filled = [r for r in even if r["documents"]]
    assert min(r["tokens"] for r in filled) >= 0.85 * max(r["tokens"] for r in filled)  # few documents: not every sum is to be had
    assert mixing.mixed(documents.limit(0), targets).count() == 0
    odd = spark.createDataFrame([(None, "x", 0.5, 2), ("m", None, 0.5, 2), ("m", "x", None, 2), ("n", "x", 1.0, None)], "mix_name string, source string, target_share double, max_repeats int")
    assert {r["mix_name"] for r in mixing.mixed(documents.withColumn("source", F.lit("x")), odd).collect()} == {None}


# --- p9

CORPUS = ["Vezmi např. stan atd. už dnes. Přijde Dr. Novák v 10.30. Na str. 5 je mapa."] * 30


def split(text, table=None):
    return [text[a:b] for a, b in sentences.Splitter(table or {}).spans(text)]


@pytest.mark.parametrize("text,want", [
    ("Kdo má stan? Nikdo. 🎉 Dr. Novák ano.", ["Kdo má stan?", "Nikdo. 🎉", "Dr. Novák ano."]),
    ("Přemek napsal: „Dorazím v 8.25.“ To je skvělé!", ["Přemek napsal: „Dorazím v 8.25.“", "To je skvělé!"]),
    ("„Přijdeš taky? Nebo zůstaneš doma?“ ptala se Vojta. Ne.", ["„Přijdeš taky? Nebo zůstaneš doma?“ ptala se Vojta.", "Ne."]),
    ("“你来吗？我们等你。”他问。太好了！", ["“你来吗？我们等你。”他问。", "太好了！"]),
    ("「来る？ 待ってるよ。」と言いました。すごい！", ["「来る？ 待ってるよ。」と言いました。", "すごい！"]),
    ("ดีมากเลยครับ ใครมีตั๋วบ้างคะ", ["ดีมากเลยครับ", "ใครมีตั๋วบ้างคะ"]),
    ("फ़ोटो किसके पास है? डॉ. शकुन ने दिया। ठीक", ["फ़ोटो किसके पास है?", "डॉ. शकुन ने दिया।", "ठीक"]),
    ("Τα λέμε, εντάξει; Ναι.", ["Τα λέμε, εντάξει;", "Ναι."]),
    ("[14:26] Eva: Ahoj. Co je\n[14:27] Jan: nic", ["[14:26] Eva: Ahoj.", "Co je", "[14:27] Jan: nic"]),
    ("1) první bez tečky\n2) druhá. Konec", ["1) první bez tečky", "2) druhá.", "Konec"]),
    ("Der 2. Versuch war besser. Am 3. Mai.", ["Der 2. Versuch war besser.", "Am 3. Mai."]),
    ("(Nejde to?!) Jde.", ["(Nejde to?!)", "Jde."]),
    ("Soubor scan-1.4.pdf se neotevře.Další je lepší.", ["Soubor scan-1.4.pdf se neotevře.", "Další je lepší."]),
    ("", []), ("  \n ", []), (None, []),
])
def test_sentences(text, want):
    assert split(text) == want


def test_wrapped_lines():
    text = "Tohle je delší věta, která se na konci řádky zalomila\na pokračuje na další řádce až do konce. A druhá\nkrátká."
    assert split(text) == [text[: text.index(" A druhá")], "A druhá\nkrátká."]


@given(st.text(max_size=120))
@settings(max_examples=150, deadline=None)
def test_spans_cover_everything(text):
    spans = sentences.Splitter({}).spans(text)
    at = 0
    for a, b in spans:
        assert at <= a < b and not text[a].isspace() and not text[b - 1].isspace() and not text[at:a].strip()
        at = b
    assert not text[at:].strip()


def test_the_document_comes_first():
    firm = {"xyz": (sentences.WORD, False), "abc": (sentences.INSIDE, False)}
    assert split("The xyz. Beta is here. We took xyz., too.", firm) == ["The xyz. Beta is here.", "We took xyz., too."]  # a comma behind the period
    assert split("See abc. Beta now. The abc is good.", firm) == ["See abc.", "Beta now.", "The abc is good."]  # and a place without one
    assert split("See abc. Beta now.", firm) == ["See abc. Beta now."]
    starts = firm | {"then": (sentences.WORD, True), "delta": (sentences.WORD, True)}
    assert split("Five abc. Then we left.", starts) == ["Five abc.", "Then we left."]  # a common word
    assert split("Five abc. Delta left, so Delta won.", starts) == ["Five abc. Delta left, so Delta won."]  # a proper name here


def test_verdicts_have_no_switches():
    kinds = [sentences.verdict("zkr", n, 0, 0, 0) for n in range(1, 400)]
    assert kinds[0] == sentences.WORD and kinds[-1] == sentences.TITLE and sum(a != b for a, b in zip(kinds, kinds[1:])) == 1
    for scale in (1, 10, 1000):
        assert sentences.verdict("dům", 30 * scale, 3 * scale, 9 * scale, 40 * scale) == sentences.WORD
        assert sentences.verdict("approx", 30 * scale, 30 * scale, 0, 0) == sentences.INSIDE


def test_sentence_frames(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*CORPUS, None, "", "Vezmi např. stan atd. Zítra přijde. " * 3000, "Sejdeme se v pol. Karel přijde, říkal pol., že ano.", CORPUS[0]])], "doc_id bigint, text string, form string")
    table = sentences.corpus_table(df)
    rows = sentences.split_documents(df, table).cache()
    assert rows.where("doc_id = 0").count() == 3
    assert rows.where(F.col("doc_id") == len(CORPUS) + 2).count() == 6000
    assert rows.where(F.col("doc_id").isin(len(CORPUS), len(CORPUS) + 1)).count() == 0
    joined = sentences.split_documents(df, table, most=-1)  # a table too large to send
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, rows.collect()))
    none = df.limit(0)
    assert sentences.split_documents(none, sentences.corpus_table(none)).count() == 0


def test_sent_and_joined_tables_agree(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    table = sentences.corpus_table(df)
    sent, joined = sentences.split_documents(df, table), sentences.split_documents(df, table, most=-1)
    assert sent.exceptAll(joined).count() == 0 and sent.count() == joined.count() > 0
