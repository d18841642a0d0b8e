"""Added spans of the secret scan: every form of assignment, planted in a generated corpus, and time that grows with the text."""

import random
import time

import pytest

from replistat.llm import secrets

# Where the literal stands in each form; V is the literal, N the name. Names that the base pattern knows are not used.
FORMS = ["{N} = \"{V}\"", "{N}: '{V}'", "{N}={V}", "let {N}: &str = \"{V}\";", "{N} := `{V}`", "conf[\"{N}\"] = \"{V}\"", "\"{N}\": \"{V}\",", "put(\"{N}\", \"{V}\")", "<add name=\"{N}\" value=\"{V}\"/>",
         "<{N}>{V}</{N}>", "{N} = /* live */ '{V}'", "{N}: >-\n    {V}\n", "{N}   \t  = \"\"\"{V}\"\"\"", "{N} = \\\n  \"{V}\"", "{N} => '{V}'", "set_{N}('{V}')"]
FILLER = ["The harbour was quiet, and nobody didn't know why.", "if (x == 3) { return call(y, \"plain text\"); }", "# note: it's only a remark", "size = 14\nmode: fast", "a \"quoted part", "width => 20, colour = 'red'"]


def literal(rng):
    return "".join(rng.sample("abcdefghjkmnpqrstuvwxyz", 7) + rng.sample("ABCDEFGHJKLMNPQRSTUVWXYZ", 5) + rng.sample("23456789", 4))


def test_planted_literals_are_found_and_nothing_else():
    rng = random.Random(5)
    for _ in range(300):
        text, want = "", []
        for _ in range(rng.randrange(1, 12)):
            if rng.random() < 0.5:
                text += rng.choice(FILLER) + "\n"
                continue
            secret = rng.random() < 0.6
            name, value, form = rng.choice(["db_pwd", "userPassphrase", "my_credentials"] if secret else ["label", "userName", "page_title"]), literal(rng), rng.choice(FORMS)
            before = form.split("{V}")[0].replace("{N}", name)
            if secret:
                want.append((len(text) + len(before), len(text) + len(before) + len(value)))
            text += form.replace("{N}", name).replace("{V}", value) + "\n"
        assert secrets.lexed(text) == want, text


@pytest.mark.parametrize("text, want", [
    ("A = 'aB3dE5'\nB = 'gH7jK9'\nuser_pwd = A + B", ["aB3dE5", "gH7jK9"]),
    ('pwd = "aB3d" "E5gH7jK9"', ["aB3d", "E5gH7jK9"]),
    ("X=aB3dE5gH7jK9\nY=X\nauth_pwd=Y", ["aB3dE5gH7jK9"]),
    ("a=b\nb=a\npwd=a", []),
    ("pwd=pwd", []),
    ('pwd = "ab\\"cD3dE5gH"', ['ab\\"cD3dE5gH']),
    ("postgres://bob:aB3dE5gH7jK9@host/db", ["aB3dE5gH7jK9"]),
    ("Authorization: Bearer aB3dE5gH7jK999Zz", ["aB3dE5gH7jK999Zz"]),
    ("-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----", ["-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----"]),
    ("-----BEGIN PRIVATE KEY-----\nabc", []),
    ("pwd = '" + "xY7" * 5000 + "aB3dE5gH7jK9'", ["xY7" * 5000 + "aB3dE5gH7jK9"]),
    ("pwd" + " " * 500 + "= 'aB3dE5gH7jK9'", ["aB3dE5gH7jK9"]),
    ("n" * 400 + "_pwd = 'aB3dE5gH7jK9'", ["aB3dE5gH7jK9"]),
    ("", []), ("'", []), ("pwd =", []), ("pwd = '", []), ("\\", []),
])
def test_single_texts(text, want):
    assert [text[s:e] for s, e in secrets.lexed(text)] == want


def test_spans_inside_base_spans_are_left_out():
    rng = random.Random(6)
    for _ in range(200):
        text = "\n".join(rng.choice(['password = "%s"', 'db_pwd = "%s"', 'my_pwd = "%032x"' % rng.getrandbits(128) + "%.0s", 'pwd = AKIA%s']) % literal(rng) for _ in range(12))
        found = secrets.scan(text)
        base = [(s, e) for k, s, e in found if k != "lexed"]
        assert [(s, e) for k, s, e in found if k == "lexed"] == [(s, e) for s, e in secrets.lexed(text) if not any(a <= s and e <= b for a, b in base)]


@pytest.mark.parametrize("part", ["password = 'aB3dE5gH7jK9'\n", '"\\"', 'pwd="""\\"""', "-----BEGIN PRIVATE KEY-----", "pwd: ", "pwd=/*", "<key", "key=a.", "pwd = '1' + ", "key: a.b ", "`'\"pwd"])
def test_time_grows_with_the_text(part):
    def spent(n):
        start = time.process_time()
        secrets.scan(part * n)
        return time.process_time() - start

    assert spent(24_000) < 12 * spent(4_000) + 0.3
