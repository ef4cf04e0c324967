import math
import random
import re

from tablesteps.llm import pii as P

from .helpers import docs, odd_docs

# The contract's patterns as they are written there.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def counts(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if counts(kind, m[0])]
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(out))


def run(df, **options):
    return P.sanitise(df, P.find_spans(df, **options), ["doc_id"])


def test_base_spans_against_brute_force(spark):
    rng = random.Random(5)
    parts = (
        "a@b.c|x.y+z@q-r.com.|_|1.2.3.4|255.256.1.1|4111 1111 1111 1111|4111-1111-1111-1111| |+1 (555) 123-4567|+|@|.|-|12|3|é𝔘|"
        "4539578763621486|  |(|)|000.01.2.3|\x01|word|Name|\n|+4930123456|4111111111111111 1|a@b|..com"
    ).split("|")
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(700)]
    rows += [(5000, None), (5001, ""), (5002, "x@y.com, " * 500), (5003, "1-11-" * 200), (5004, "a@b" + ".c" * 300)]
    got = {r.doc_id: r.base_spans for r in run(docs(spark, rows)).collect()}
    assert got == {d: base(t) for d, t in rows}


def test_very_long_runs_end_in_time(spark):
    rows = [(1, "9" * 200_000), (2, "a" * 200_000 + "@"), (3, "1-11-" * 40_000), (4, "a@b" + ".c" * 50_000)]
    got = {r.doc_id: (r.n_email, len(r.clean)) for r in run(docs(spark, rows)).collect()}
    assert got == {1: (0, 200_000), 2: (0, 200_001), 3: (0, 200_000), 4: (1, len("[EMAIL]"))}


def filler(n):
    return [(i, f"plain number w{i} of the weather on day q{i}, the alpha of it") for i in range(n)]


def test_terms_that_reveal_an_entity_go(spark):
    rows = filler(300) + [(400 + i, f"letter z{i}00 from Zebulon here to zeb@corp.example u{i} of the alpha desk") for i in range(5)]
    out = {r.doc_id: r for r in run(docs(spark, rows)).collect()}
    one = out[402]
    assert "Zebulon" not in one.clean and "zeb@" not in one.clean and "[EMAIL]" in one.clean
    assert " the " in one.clean and "alpha" in one.clean  # common words say nothing
    assert re.search(r"term:17:24", one.spans) and one.n_term >= 1 and one.base_spans == "email:33:49"
    assert all(out[i].clean == rows[i][1] and out[i].spans == "" for i in range(300))  # documents without the entity stay


def test_copies_are_one_context(spark):
    rows = filler(50) + [(100 + i, "note from Quill to q@corp.example about it") for i in range(10)]
    assert {r.n_term for r in run(docs(spark, rows)).collect()} == {0}


def test_partial_disclosure_is_generalised(spark):
    rows = filler(400) + [(500 + i, f"a{i}00 Marlow b{i} m@corp.example c{i}") for i in range(4)] + [(600 + i, f"Marlow walks w{i}") for i in range(8)]
    out = {r.doc_id: r.clean for r in run(docs(spark, rows)).collect()}
    assert out[501] == "a100 [word] b1 [EMAIL] c1" and out[601] == "Marlow walks w1"


def test_empty_table_repeats_and_odd_columns(spark):
    assert run(docs(spark, [])).collect() == []
    df = odd_docs(spark, [(1, "to a@b.co"), (None, "to a@b.co"), (1, "to a@b.co"), (2, None)])
    out = P.sanitise(df, P.find_spans(df), df.columns)
    assert out.columns[: len(df.columns)] == df.columns
    assert sorted((r["a.b"], r.n_email, r.clean) for r in out.collect()) == [
        (0, 1, "to [EMAIL]"), (1, 1, "to [EMAIL]"), (2, 1, "to [EMAIL]"), (3, 0, ""),
    ]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_terms_far_from_an_entity(spark):
    far = " ".join(f"on day q{i} of the weather" for i in range(8))
    rows = filler(300) + [(400 + i, f"Bo Zebulon h{i} {far} f{i} to zeb@corp.example") for i in range(5)]
    rows += [(500 + i, f"林木 p{i} {far} r{i} to lin@corp.example") for i in range(2)] + [(600, f"Quill {far} to q@corp.example")]
    out = {r.doc_id: r.clean for r in run(docs(spark, rows)).collect()}
    for i in range(5):
        assert out[400 + i].split()[0] == f"h{i}" and "[EMAIL]" in out[400 + i]
    assert out[500].startswith("[word] p0 ") and out[501].startswith("[word] p1 ")  # two texts: less sure
    assert out[600].startswith("Quill ")  # one text tells a name from no other rare word


def bits(value):
    return sum(value.count(c) * math.log2(len(value) / value.count(c)) for c in set(value))


def test_secrets_by_name_and_information(spark):
    rng = random.Random(8)
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    kept = [
        f"signed with {key} today", "token = aaaaaaaaaaaaaaaaaaaaaaaa", "the token: something about it", "api_key=short1", "secret = ",
        "tokens = words that go on", f"nottoken{key}", "password: ........................",
    ]
    rows = [(i, t) for i, t in enumerate(kept)]
    gone = [f'a token = "{key}" b', f"API-KEY: {key}, mail x@y.com", f"passwd='{key}=='", f"my secret:{key}.", f"token = {key}\naccess_key = {key[::-1]}"]
    rows += [(100 + i, t) for i, t in enumerate(gone)]
    out = {r.doc_id: r for r in run(docs(spark, rows)).collect()}
    assert all(out[i].clean == t and out[i].n_secret == 0 for i, t in enumerate(kept))
    assert [out[100 + i].clean for i in range(5)] == [
        'a token = "[SECRET]" b', "API-KEY: [SECRET], mail [EMAIL]", "passwd='[SECRET]'", "my secret:[SECRET]", "token = [SECRET]\naccess_key = [SECRET]",
    ]
    assert out[100].spans == "secret:11:51" and out[100].base_spans == "" and out[101].base_spans == "email:56:63"
    # The bound against a brute force over values of many kinds.
    values = ["".join(rng.choice("0123456789abcdef"[: rng.choice([1, 2, 4, 16])]) for _ in range(rng.randint(8, 40))) for _ in range(200)]
    out = {r.doc_id: r.n_secret for r in run(docs(spark, [(i, f"token={v} is it") for i, v in enumerate(values)])).collect()}
    assert out == {i: int(len(v) >= 12 and bits(v) >= P.SECRET_BITS) for i, v in enumerate(values)}
    assert 0 < sum(out.values()) < 200


def told_by_brute_force(rows, generalise):
    """Every entity and term, weighed by its definition."""
    texts = [(t or "", set(re.findall(r"[^\W_]+", (t or "").lower())), set(re.findall(r"[a-z0-9]+@[a-z.]+", t or ""))) for _, t in rows]
    out = {}
    for e in set().union(*(es for _, _, es in texts)):
        holders = [(t, ws) for t, ws, es in texts if e in es]
        if len({t for t, _ in holders}) < P.least_support(generalise):
            continue
        for w in set().union(*(ws for _, ws in holders)):
            both = [t for t, ws in holders if w in ws]
            n_term = sum(w in ws for _, ws, _ in texts)
            own = math.log(len(texts) / len(holders))
            shared = math.log(len(both) * len(texts) / (len(holders) * n_term))
            disclosure = (1 - 0.5 ** len(set(both))) * shared / own if own > 0 else 0.0
            if disclosure >= generalise:
                out["email:" + e, w] = round(disclosure, 9)
    return out


def random_mail(seed, n=160):
    rng = random.Random(seed)
    people = [f"p{i}@x.org" for i in range(9)]
    rows = []
    for i in range(n):
        words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(0, 25))]
        for p in rng.sample(people, rng.choice([0, 0, 0, 1, 2, 5])):
            words.insert(rng.randint(0, len(words)), p)
            if rng.random() < 0.7:
                words.append(f"n{p[1]}")
        rows.append((i, " ".join(words)))
    return rows + [(n, rows[3][1]), (n + 1, None), (n + 2, rows[5][1]), (n + 3, " ".join(people) + " together with n1 n2 n3")]


def test_disclosures_against_brute_force(spark):
    for seed in (1, 2):
        rows = random_mail(seed)
        texts = P.hashed(docs(spark, rows), "doc_id", "text")
        want = told_by_brute_force(rows, P.GENERALISE)
        assert len(want) > 5
        for cell in (P.CELL, 2):  # in one cell, and dealt in many
            told, entities = P.disclosures(texts, P.base_spans(texts), P.GENERALISE, cell)
            assert {(r.entity, r.term): round(r.disclosure, 9) for r in told.join(entities, "eclass").collect()} == want


def test_many_entities_and_words_of_one_text_are_one_pair_of_classes(spark):
    """An archive of 300 addresses and 3,000 words in two texts: 900,000 pairs, but one of classes."""
    body = " ".join(f"user{i}@corp.example" for i in range(300)) + " " + " ".join(f"word{i}x" for i in range(3000))
    rows = filler(200) + [(500, body), (501, body + " again")]
    texts = P.hashed(docs(spark, rows), "doc_id", "text")
    told, entities = P.disclosures(texts, P.base_spans(texts), P.GENERALISE)
    assert entities.count() == 300 and entities.select("eclass").distinct().count() == 1
    terms = {r.term for r in told.collect()}
    assert terms >= {f"word{i}x" for i in range(3000)} and "again" not in terms and told.count() == len(terms)


def test_recall_of_planted_names(spark):
    """40 people, each named in two to five letters of random words: at least 0.9 of the names go, hardly another word."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(60))) for i in range(1500)]
    named = {}
    for p in range(40):
        for _ in range(rng.randint(2, 5)):
            words = [rng.choice(common) for _ in range(60)]
            words.insert(rng.randint(0, 60), f"Name{p}")
            words.insert(rng.randint(0, 60), f"mail{p}@corp.example")
            named[len(rows)] = f"Name{p}"
            rows.append((len(rows), " ".join(words)))
    out = {r.doc_id: r for r in run(docs(spark, rows)).collect()}
    caught = sum(name not in out[d].clean for d, name in named.items())
    assert caught >= 0.9 * len(named)
    assert sum(r.n_term for r in out.values()) <= 1.1 * caught


def test_plans_hold_no_python(spark):
    df = docs(spark, random_mail(3))
    texts = P.hashed(df, "doc_id", "text")
    spans = P.base_spans(texts)
    told, entities = P.disclosures(texts, spans, P.GENERALISE)
    for made in (spans, told, entities, P.term_spans(texts, spans, told, entities, P.REMOVE), run(df)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
