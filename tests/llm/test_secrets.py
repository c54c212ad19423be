"""The secret scan: patterns against plain rules, grammars by what they accept and by held-out strings."""

import hashlib
import random
import re
import string

import pytest

from swarmlake.llm.secret_scan import Automaton, base_spans, samples, scan

DOCS = "doc_id long, text string, id long, spans string, t string, kind string"
KINDS = ["assign", "access", "hex", "likely"]
B62 = string.ascii_letters + string.digits


def plain_base(text):
    """The contract's rules, run by run."""
    out = []
    for m in re.finditer(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end()))
    for k, (rule, least) in enumerate([("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32)]):
        out += [(m.start(), k + 1, m.end()) for m in re.finditer(rule, text) if len(m[0]) >= least]
    return sorted(out)


def texts():
    r = random.Random(1)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    bits = ["token = ", "secret:", "API_KEY='", 'Passwd" = "', "apikey=", "paſſword=", "toKen:", "AKIA", "AKIA" + "Z9" * 6, "AKIAAKIA1234567", hexes(31), hexes(32), hexes(90), "word", " ", "é", "abcd", "=", "x" * 9, "12345678", "\n", ":", '"']
    return ["".join(r.choice(bits) for _ in range(r.randrange(25))) for _ in range(300)]


@pytest.fixture(scope="module")
def rows():
    """Credentials of two formats with keywords (labelled) and without, in prose with numbers, addresses and links."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 15)))
    live = lambda: "sk_" + "".join(r.choice(B62) for _ in range(24))
    hexed = lambda: "".join(r.choice("0123456789ABCDEF") for _ in range(40))
    noise = lambda: r.choice([f"{word()}.{r.randrange(99)}@mail.example.com", f"2024-0{r.randrange(1, 9)}-1{r.randrange(9)}", str(r.randrange(10**8, 10**12)), f"/usr/{word()}/{word()}", "INTERNATIONAL"])
    out, bare = [], {}
    for i in range(400):
        said = [word() for _ in range(60)] + [noise() for _ in range(6)]
        r.shuffle(said)
        if i % 4 == 0:
            said[5] = f"token = {r.choice([live, hexed])()}"
        if i % 4 == 1:
            said[9] = bare[i] = r.choice([live, hexed])()
        out.append((i, " ".join(said)))
    return out, bare


def scanned(spark, rows, **how):
    return scan(spark.createDataFrame([(i, t, 0, "s", "t", "k") for i, t in rows], DOCS), **how).collect()


def test_patterns():
    for t in texts():
        assert sorted((s, KINDS.index(k), e) for s, k, e, _ in base_spans(t)) == plain_base(t)


def test_rows(spark):
    own = [*enumerate(texts()), (None, None), (1, ""), (1, "token=abcdefgh"), (1, "token=abcdefgh"), (5, "w " * 300_000 + "token: abcdefgh1")]
    got = scanned(spark, own)
    want = []
    for i, t in own:
        found = plain_base(t or "")
        said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
        want.append((i, *(sum(k == n for _, k, _ in found) for n in range(3)), hashlib.sha256(said.encode()).hexdigest(), said))
    assert sorted(map(str, (tuple(g[:5]) for g in got))) == sorted(map(str, (w[:5] for w in want)))
    for g, w in zip(sorted(got, key=lambda g: str(tuple(g[:5]))), sorted(want, key=lambda w: str(w[:5])), strict=True):
        spans = [s for s in g["spans"].split(",") if s and not s.startswith("likely")]
        assert ",".join(spans) == w[5]
    assert scanned(spark, []) == []


def test_unlabelled_credentials_are_found(spark, rows):
    """Held out: credentials without a keyword. At least nine of ten are found, and hardly another run."""
    docs, bare = rows
    right, wrong = 0, []
    for g in scanned(spark, docs):
        text = docs[g["doc_id"]][1]
        for kind, s, e in (x.split(":") for x in g["spans"].split(",") if x):
            if kind == "likely":
                run = text[int(s) : int(e)]
                if run == bare.get(g["doc_id"]):
                    right += 1
                else:
                    wrong.append(run)
    assert right >= 0.9 * len(bare)
    assert len(wrong) <= 0.01 * len(docs), wrong


def test_long_values_teach_nothing(spark, rows):
    """Runs of more than LONGEST characters fill no sample, and are spans as before."""
    long = [(1000 + i, f"token = {'x' * 600}{i}") for i in range(40)]
    labelled, others = samples(spark.createDataFrame([(i, t) for i, t in rows[0] + long], "doc_id long, text string"), "text", 2000, 6000)
    assert len(labelled["assign"]) == 100 and all(len(v) <= 512 for v in [*labelled["assign"], *others])
    assert [g["n_assign"] for g in scanned(spark, long)] == [1] * 40


def test_no_grammar_without_labels(spark, rows):
    docs = [(i, t.replace("token = ", "")) for i, t in rows[0]]
    assert all(not g["spans"] for g in scanned(spark, docs))


def test_merged_states():
    """Strings of (ab)* c: the tree's states become few, and longer strings of the language stay likely."""
    r = random.Random(4)
    a = Automaton("ab" * min(60, int(r.expovariate(0.5))) + "c" for _ in range(3000))
    assert len(a.states) <= 4
    assert a.likelihood("ab" * 12 + "c") > a.likelihood("ab" * 12 + "b") + 3
    assert a.likelihood("abc") > a.likelihood("bac") + 3
