"""Strings that every match of a pattern holds, against the patterns themselves."""

import random
import re

import pytest
from riskframe.operators.detect import engine
from riskframe.operators.detect import rules as R
from riskframe.operators.ledger import file_packs, repo_packs

FLAGS = sorted({p for pack in (*file_packs().values(), *repo_packs().values()) for p in pack["flags"].values()})


def test_needed_strings():
    assert engine.needed(r"(?i)\bhmacCheck\s*\(|\bjwt\.Verify\s*\(") == ("hmaccheck", "jwt.verify")
    assert engine.needed(r"(?:ab)?cd+e") == () and engine.needed(r"x*(?:foo|b)") == () and engine.needed(r"[[a]b]foo") == () and engine.needed(r"\p{L}foo") == ()
    assert engine.needed(r"(?:foo){0,2}bar") == ("bar",) and engine.needed(r"(?!foo)barbaz") == ("barbaz",) and engine.needed(r"é+foo") == ("foo",)


def test_every_match_holds_a_needed_string():
    rnd = random.Random(2)
    parts = ["foo", "Bar", r"\s*", "(?:ab|cd)", "(?:ab|c)?", "[xy]+", "z{0,2}", "(?:qu|Qu[ae]){1,2}", "(?=f)", r"\.", "(?:a|bc)"]
    alphabet = ["foo", "bar", "FOO", " ", "ab", "cd", "c", "x", "zz", "qu", "QUa", ".", "a", "bc"]
    hits = 0
    for _ in range(400):
        pattern = rnd.choice(["", "(?i)"]) + "".join(rnd.choices(parts, k=rnd.randrange(1, 4)))
        words = engine.needed(pattern)
        for _ in range(60):
            text = "".join(rnd.choices(alphabet, k=rnd.randrange(8)))
            if words and re.search(pattern, text):
                hits += 1
                assert any(w in text.lower() for w in words), (pattern, text)
    assert hits > 200 and sum(bool(engine.needed(p)) for p in FLAGS) > 0.9 * len(FLAGS)


@pytest.mark.parametrize("pack", [R.CRYPTO, R.BACKDOORS])
def test_flags_as_the_patterns_alone(spark, pack):
    texts = ["createHash('MD5').update(password)", "JWT.VERIFY(token)", "ſ jwt.verify (", "İ createhash(\"sha1\")", "", None, "K PKCE K", "token === 'dev'", "accept  any"]
    files = spark.createDataFrame([("r", f"p{i}", t) for i, t in enumerate(texts)], "repo string, path string, content string")
    alone = files.select("path", *[files["content"].rlike(p).alias(n) for n, p in pack["flags"].items()])
    assert sorted(map(str, engine.flag_table(files, pack["flags"]).drop("repo").collect())) == sorted(map(str, alone.collect()))
