from riskloom.llm.identities import author_name, fold, identity_pairs, is_role, link_identities, one_typo


def test_names():
    assert author_name("Gomtelniley, Noor") == ("full", "noor", "gomtelniley") and author_name("Noor K. Gomtelniley") == ("full", "noor", "gomtelniley")
    assert author_name("Jortytreard I") == ("initial", "i", "jortytreard") and author_name("B. Tammor") == ("initial", "b", "tammor")
    assert author_name("amberwren10o")[0] == "login" and author_name("")[0] == "none"
    assert fold("Rüdroniski") == fold("Ruedroniski") == fold("RUDRONISKI") and fold("Søren Łukasz") == "soren lukasz"
    assert is_role("build-bot", "x@y") and is_role("root", "r@y") and not is_role("Robin Root", "r@y") and not is_role("Bo Agent", "")


def test_one_typo():
    assert one_typo("gomtelniley", "gomtelnilry") and one_typo("abc", "acb") and one_typo("abc", "ab") and one_typo("ab", "abb")
    assert not one_typo("abc", "abc") and not one_typo("abcd", "badc") and not one_typo("", "ab")


PEOPLE = [
    ["Robert Drodalaham <robert.drodalaham@firm.example>", "DRODALAHAM, Robert <robert.drodalaham@firm.example>", "Bob Drodalaham <bob@laptop-1.lan.example>",
     "R. Drodalaham <rd@mail.example>", "Robert Drodalahma <owl17x@mail.example>", "owl17x <owl17x@post.example>", "Robert Drodalaham <88+owl17x@users.noreply.hub.example>", "Robert Drodalaham <Robert.Drodalaham+ci@firm.example>"],
    ["Karl Lindo <karl.lindo@firm.example>", "K. Lindo <karl.lindo@firm.example>"],
    ["Karl Lindo <karl.lindo2@firm.example>", "Lindo K <karl.lindo2@firm.example>"],
    ["Elias Bratelzewitz <elias.b@firm.example>"], ["Emil Bratelzewitz <emil.b@firm.example>"], ["E. Bratelzewitz <eb@mail.example>"],
]
NOBODY = ["build-bot <build-bot@x.example>", "root <root@ci.example>", "wren99z <wren99z@post.example>"]


def rows(spark, idents):
    return spark.createDataFrame([(*i[:-1].split(" <"), "x") for i in idents] + [(None, "a@b", "x"), ("A B", None, "x")], "author string, author_email string, person string")


def test_people_are_told_apart(spark):
    idents = [i for p in PEOPLE for i in p] + NOBODY
    got = {}
    for r in link_identities(rows(spark, idents * 2)).collect():
        got.setdefault(r.person, set()).add(r.ident)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, PEOPLE))
    pairs = identity_pairs(link_identities(rows(spark, idents))).collect()
    assert len(pairs) == sum(len(p) * (len(p) - 1) // 2 for p in PEOPLE) and all(r.ident_a < r.ident_b for r in pairs)


def test_empty_and_long(spark):
    assert link_identities(rows(spark, [])).count() == 0
    assert link_identities(rows(spark, ["x" * 50000 + " Y <@>", "  <>", ", <a>"])).count() >= 0
