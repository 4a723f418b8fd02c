import random

import numpy as np
from helpers import frame, prose

from tablescope.llm import secret_scan as S

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def code(r, n, alphabet=LETTERS):
    return "".join(r.choice(alphabet) for _ in range(n))


def plain(k, n):
    return " ".join(w.rstrip("0123456789") for w in prose(k, n).split())


def spans(spark, rows, model=None):
    return {x["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in x["spans"]] for x in S.scan(frame(spark, rows), model).collect()}


def test_digit_free_secrets_are_found(spark):
    r = random.Random(8)
    rows = [(k, f"{plain(k, 20)} {r.choice(['password=', 'token: ', 'api_key='])}{code(r, 20)} {plain(k + 1, 9)} InternationalName {plain(k + 2, 5)}") for k in range(300)]
    model = S.train(frame(spark, rows))
    planted, held = {}, []
    for k in range(1000, 1060):
        head, secret = plain(k, 15) + r.choice([" my password is ", " the token was "]), code(r, 20)
        planted[k] = ("crf", len(head), len(head) + 20)
        held.append((k, head + secret + " " + plain(k + 7, 15)))
    held += [(k, plain(k, 60) + " InternationalName " + plain(k + 1, 9)) for k in range(2000, 2060)]
    got = spans(spark, held, model)
    assert sum(planted[k] in got[k] for k in planted) >= 0.9 * len(planted)
    assert sum(len(got[k]) for k in range(2000, 2060)) == 0


def test_decoding_is_viterbi_over_all_tokens():
    r, draw = random.Random(5), np.random.default_rng(5)
    pieces = ["alpha", "Beta", "password", "=", ":", " ", " ", " ", "|", '"', "é", "x9f3kd82jfQ", "QwErTyUiOp", "1234567890", "\n", "日本", "a.b", "||"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 60))) for _ in range(300)] + ["", " ", "|", "a" * 70_000 + "1"]
    some = screened = 0
    for turn in range(6):
        m = S.Crf()
        m.t = draw.normal(size=(3, 3))
        for text in texts[:200]:
            for row in S.chain_features(text, S.tokens_of(text), S.file_features(text)):
                for name in row:
                    if name not in m.w:
                        m.w[name] = draw.normal(size=3) * 0.7 + [0.25 * turn, 0, 0]
        tagger = S.Tagger(m)
        for text in texts:
            c = S.tokens_of(text)
            if not c:
                assert S.crf_spans(text, tagger, []) == [] and not tagger.may_hold(text)
                continue
            tokens, names = [text[a:b] for a, b in c], S.chain_features(text, c, S.file_features(text))
            starts, ends, s = tagger.scores(text)
            assert list(zip(starts, ends)) == c and np.allclose(s, m.scores(tokens, names))
            got = [0] * len(c)
            for at, tags in tagger.tags(s):
                got[at:at + len(tags)] = tags
            assert got == m.viterbi(tokens, names)
            assert tagger.may_hold(text) or not any(got)
            some += sum(got)
            screened += not tagger.may_hold(text)
    assert some and screened


def test_training_chains_keep_every_labelled_secret():
    text = f"{plain(1, 30)} password=correcthorse {plain(2, 30)} secret: abc.def+gh {plain(3, 30)}"
    c = S.tokens_of(text)
    marked = [text[c[lo + k][0]:c[lo + k][1]] for lo, _, tags, _ in S.training_chains(text) for k, t in enumerate(tags) if t]
    assert marked == ["correcthorse", "abc", ".", "def+gh"]


def test_long_and_dotted_secrets_after_a_number(spark):
    r = random.Random(21)
    full = LETTERS + "0123456789"
    jwt = lambda *sizes: ".".join(code(r, n, full) for n in sizes)
    kinds = [lambda: code(r, 200, full), lambda: code(r, 200), lambda: jwt(36, 90, 43), lambda: jwt(20, 20, 20, 20, 20), lambda: code(r, 5000) + code(r, 30, full)]
    rows = [(k, f"{plain(k, 12)} id {r.randrange(10**7, 10**8)} {r.choice(['password=', 'token: '])}{kinds[k % 5]()} {plain(k + 1, 12)}.") for k in range(400)]
    model = S.train(frame(spark, rows))
    held, want = [], {}
    for k in range(50):
        head, secret = f"{plain(k, 9)} id {r.randrange(10**7, 10**8)} ", kinds[k % 5]()
        held.append((k, f"{head}{secret} {plain(k + 3, 12)}"))
        want[k] = [("crf", len(head), len(head) + len(secret))]
    assert spans(spark, held, model) == want


def test_keyless_secrets_of_other_looks_than_the_labels(spark):
    """All labels are quoted digests of 40 hexadecimal digits; planted are others, after other words or none."""
    r = random.Random(30)
    rows = [(k, f"{plain(k, 30)}" + (f' token = "{code(r, 40, "0123456789abcdef")}" {plain(k + 1, 9)}' if k % 4 == 0 else " Thhsheitschlichkeiten (017) 555-7713 LOUDWORDS!!")) for k in range(800)]
    model = S.train(frame(spark, rows))
    held, want = [], {}
    for k in range(200):
        head = plain(k + 50, 20) + r.choice([" auth=", " credential: ", " bearer ", " the private key is ", " "])
        want[k] = ("crf", len(head), len(head) + 24)
        held.append((k, head + code(r, 24, LETTERS + "0123456789") + " " + plain(k + 2, 20)))
    held += [(1000 + k, plain(k, 60) + " Thhsheitschlichkeiten (017) 555-7713 LOUDWORDS!! " + plain(k, 5)) for k in range(200)]
    got = spans(spark, held, model)
    assert sum(want[k] in got[k] for k in want) >= 0.9 * len(want)
    assert sum(len(got[1000 + k]) for k in range(200)) <= 2


def test_very_long_stretches_are_learnt_in_parts():
    r = random.Random(2)
    text = " ".join(f"{code(r, 12)}1" for _ in range(3000)) + " password=" + ".".join(code(r, 9) for _ in range(400))
    parts = S.training_chains(text)
    assert max(hi - lo for lo, hi, _, _ in parts) <= 4 * S.CHAIN and all(tags[0] != 2 for *_, tags, _ in parts)
    assert any(kind == 0 for *_, kind in parts)
