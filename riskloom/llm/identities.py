"""Variant spellings of people's names, linked by merging profiles and matching the richer profiles again."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..runtime import cut

#: Words that mark role and machine accounts (fixed values).
ROLE_WORDS = frozenset(
    "admin administrator agent automation bot bots build builder buildbot ci cron daemon deploy deployer jenkins mailer noreply nobody "
    "ops postmaster release robot root runner script service support system team webmaster www".split()
)

#: Short forms of given names and the full forms they may stand for (fixed values).
NICKNAMES = {
    short: full.split()
    for short, full in {
        "abby": "abigail", "al": "albert alan alexander alfred", "alex": "alexander alexandra alexandre", "andy": "andrew andreas", "annie": "anna anne", "ben": "benjamin benedict", "bert": "albert robert",
        "beth": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher christian christina christine",
        "chuck": "charles", "dan": "daniel", "danny": "daniel", "dave": "david", "debbie": "deborah", "dick": "richard", "dima": "dmitri dmitry", "don": "donald", "drew": "andrew", "ed": "edward edgar edwin",
        "eddie": "edward", "fred": "frederick alfred", "fritz": "friedrich", "gabi": "gabriele gabriela", "gabe": "gabriel", "gene": "eugene", "greg": "gregory", "hank": "henry", "hannes": "johannes", "hans": "johannes",
        "harry": "harold henry", "jack": "john", "jake": "jacob", "jan": "johannes", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald jerome", "jim": "james", "jimmy": "james", "joe": "joseph",
        "joey": "joseph", "jon": "jonathan", "josh": "joshua", "kate": "katherine catherine", "katie": "katherine", "kathy": "katherine", "katya": "ekaterina", "ken": "kenneth", "larry": "lawrence", "lena": "elena magdalena helena",
        "leo": "leonard leonardo", "lisa": "elisabeth elizabeth", "liz": "elizabeth", "lou": "louis louise", "maggie": "margaret", "manny": "manuel emmanuel", "marge": "margaret", "matt": "matthew", "max": "maximilian maxwell",
        "meg": "margaret", "mick": "michael", "mike": "michael", "misha": "mikhail", "mitch": "mitchell", "molly": "mary", "nate": "nathan nathaniel", "ned": "edward", "nick": "nicholas nicolas", "paco": "francisco", "pancho": "francisco",
        "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pepe": "jose", "pete": "peter", "phil": "philip", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel samantha",
        "sandy": "alexandra sandra", "sasha": "alexander alexandra", "sepp": "josef joseph", "steve": "steven stephen", "sue": "susan", "susie": "susan", "ted": "theodore edward", "theo": "theodore", "tim": "timothy", "tom": "thomas",
        "tommy": "thomas", "toni": "antonia antonio", "tony": "anthony antonio", "uli": "ulrich ulrike", "vanya": "ivan", "vicky": "victoria", "vic": "victor", "volodya": "vladimir", "will": "william", "wolf": "wolfgang", "zhenya": "evgeny evgenia",
    }.items()
}

_LETTERS = str.maketrans({"ß": "ss", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "œ": "oe", "ı": "i"})
_DIGRAPHS = re.compile("(?<=[aou])e")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_LOCAL_NAME = re.compile(r"([a-z\-]{2,})[._]([a-z\-]{2,}?)(\d*)")
_HANDLE = re.compile(r"(?=.*\d)[a-z][a-z0-9\-]{4,}")


def fold(text: str) -> str:
    """Lower case without marks; ä, ae and a fall together, as do ö, oe, o, ø and ü, ue, u."""
    plain = unicodedata.normalize("NFKD", text.casefold().translate(_LETTERS))
    return _DIGRAPHS.sub("", "".join(c for c in plain if not unicodedata.combining(c)))


def author_name(author: str) -> tuple[str, str, str]:
    """(kind, first, last): kind is full, initial (first is one letter), login or none."""
    text = unicodedata.normalize("NFKC", author).strip()
    if "," in text:
        last, _, first = text.partition(",")
        text = f"{first} {last}"
    tokens = [fold(t) for t in _TOKEN.findall(text.replace(".", " ").replace("_", " "))]
    words = [t for t in tokens if len(t) > 1]
    if " " not in text.strip() and any(c.isdigit() for c in text):
        return "login", "", ""
    if len(words) >= 2:
        return "full", words[0], words[-1]
    if len(words) == 1 and len(tokens) == 2:
        return "initial", next(t for t in tokens if len(t) == 1), words[0]
    return ("login" if len(tokens) == 1 else "none"), "", ""


def is_role(author: str, email: str) -> bool:
    """Whether the name of an account is made of role words."""
    tokens = [t for t in re.split(r"[^a-z]+", author.casefold()) if t]
    marks = [t for t in tokens if t in ROLE_WORDS]
    return "[bot]" in author.casefold() or bool(tokens) and 2 * len(marks) >= len(tokens) and (len(marks) == len(tokens) or "-" in author or " " not in author.strip())


def evidence(author: str, email: str) -> dict:
    """What one spelling says of its person."""
    kind, first, last = author_name(author)
    address = email.strip().casefold()
    local, _, domain = address.rpartition("@")
    tagged, _, tag = local.partition("+")
    strong, base, handle = [], None, ""
    if "noreply" in domain and tag:
        handle = tag
    elif local:
        strong.append(f"m:{tagged}@{domain}")
        if _HANDLE.fullmatch(tagged) and not _LOCAL_NAME.fullmatch(tagged):
            handle = tagged
    login = author.strip().casefold() if kind == "login" else ""
    for h in {handle, login} - {""}:
        strong.append(f"h:{h}")
    names, confirmed, number = [], False, ""
    m = _LOCAL_NAME.fullmatch(tagged) if not handle else None
    if kind == "full":
        names.append((first, last))
    if m:
        mail = (fold(m[1]), fold(m[2]))
        number = m[3]
        if number:
            base = f"m:{tagged[: -len(number)]}@{domain}"
        if kind in ("full", "initial") and mail not in names:
            names.append(mail)
        confirmed = True
    elif kind == "full" and fold(tagged).endswith(last):
        confirmed = True
    return {
        "role": is_role(author, email), "kind": kind, "login": login, "handle": handle, "strong": strong, "base": base,
        "names": [f"{a}|{b}" for a, b in names], "initial": f"{first}|{last}" if kind == "initial" and not names else None, "confirmed": confirmed,
    }


_EVIDENCE = StructType(
    [StructField("role", BooleanType()), *[StructField(c, StringType()) for c in ("kind", "login", "handle")], StructField("strong", ArrayType(StringType())), StructField("base", StringType()),
     StructField("names", ArrayType(StringType())), StructField("initial", StringType()), StructField("confirmed", BooleanType())]
)


@pandas_udf(_EVIDENCE)
def _evidence(author: pd.Series, email: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([evidence(a, e) for a, e in zip(author, email)], columns=_EVIDENCE.names)


def one_typo(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or swap of neighbours turns a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


@pandas_udf(ArrayType(StringType()))
def _nick_keys(names: pd.Series) -> pd.Series:
    """Names that a nickname in one of the names may stand for."""
    return pd.Series([sorted({f"{full}|{n.split('|')[1]}" for n in ns for full in NICKNAMES.get(n.split("|")[0], ())}) for ns in names])


@pandas_udf(ArrayType(StringType()))
def _typo_keys(names: pd.Series) -> pd.Series:
    """Names with one letter of a surname of at least seven letters left out, and the names themselves."""
    out = []
    for ns in names:
        keys = set()
        for n in ns:
            first, last = n.split("|")
            if len(last) >= 7:
                keys |= {n, *(f"{first}|{last[:i]}{last[i + 1:]}" for i in range(len(last)))}
        out.append(sorted(keys))
    return pd.Series(out)


@pandas_udf(BooleanType())
def _typo_pair(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([any(x.split("|")[0] == y.split("|")[0] and one_typo(x.split("|")[1], y.split("|")[1]) for x in p for y in q) for p, q in zip(a, b)])


def components(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """Smallest label of each connected set of ids, two ids being connected by a key they share: (id, label).

    Labels spread through the keys until none changes; every round is two map-side minima, whatever the size of a key's set.
    """
    while True:
        least = keys.join(labels, "id").groupBy("key").agg(F.min("label").alias("low"))
        spread = keys.join(least, "key").groupBy("id").agg(F.min("low").alias("low"))
        after = cut(labels.join(spread, "id", "left").select("id", F.least("label", F.coalesce("low", "label")).alias("new"), "label"))
        changed = after.where(F.col("new") != F.col("label")).limit(1).count()
        labels = after.select("id", F.col("new").alias("label"))
        if not changed:
            return labels


def _profiles(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per person so far, with the union of its spellings."""
    return (
        facts.join(labels, "id")
        .groupBy("label")
        .agg(
            F.array_distinct(F.flatten(F.collect_set("open_names"))).alias("names"),
            F.collect_set("initial").alias("initials"),
            F.max("confirmed").alias("confirmed"),
        )
    )


def _weak_links(profiles: DataFrame) -> DataFrame:
    """Links (label, to) that the richer profiles allow, each only if it leaves no choice.

    A profile that knows only an initial goes to the one full name it abbreviates, a nickname to the one formal name it
    stands for, and a spelling that no address confirms to the one name that differs by a typing error. Candidates
    are found by shared keys; per key only the smallest and largest label are kept, which tells whether there is
    one or more, so nothing grows with the number of people under a key.
    """
    named = profiles.where(F.size("names") > 0)
    initial = F.transform("names", lambda n: F.concat(F.substring(n, 1, 1), F.lit("|"), F.substring_index(n, "|", -1)))
    targets = named.select(F.col("label").alias("to"), F.explode(F.array_distinct(initial)).alias("key"))
    seekers = profiles.where((F.size("names") == 0) & (F.size("initials") > 0)).select("label", F.explode("initials").alias("key"))

    def sole(targets: DataFrame) -> DataFrame:
        return targets.groupBy("key").agg(F.min("to").alias("to"), F.max("to").alias("other"))

    abbreviated = seekers.join(sole(targets), "key").where(F.col("to") == F.col("other")).select("label", "to")
    full = named.select(F.col("label").alias("to"), F.explode("names").alias("key"))
    nick = named.select("label", F.explode(_nick_keys("names")).alias("key")).join(full, "key").where(F.col("label") != F.col("to")).groupBy("label").agg(F.min("to").alias("to"), F.max("to").alias("other"))
    nick = nick.where(F.col("to") == F.col("other")).select("label", "to")
    near = named.select(F.col("label").alias("to"), F.col("names").alias("theirs"), F.explode(_typo_keys("names")).alias("key"))
    lost = named.where(~F.col("confirmed")).select("label", "names", F.explode(_typo_keys("names")).alias("key"))
    typo = lost.join(near, "key").where((F.col("label") != F.col("to")) & _typo_pair("names", "theirs")).groupBy("label").agg(F.min("to").alias("to"), F.max("to").alias("other"))
    typo = typo.where(F.col("to") == F.col("other")).select("label", "to")
    return abbreviated.unionByName(nick).unionByName(typo).where(F.col("label") != F.col("to"))


def _left(rows: DataFrame, other: DataFrame, on: str, asks: Column) -> DataFrame:
    """rows left joined to other, of which only those that ask take part: the others, which all share one value, meet no task of the join."""
    flag = next(c for c in other.columns if c != on)
    return rows.where(asks).join(other, on, "left").unionByName(rows.where(~asks).withColumn(flag, F.lit(None).cast("boolean")))


def link_identities(rows: DataFrame, author: str = "author", email: str = "author_email") -> DataFrame:
    """Identities (distinct spellings of name and address) with the person they belong to.

    Merge and rematch: spellings that share a mailbox, a login or a full name are merged; a merged profile holds the union
    of its members' spellings and initials, enters blocking again under all of them, and takes in profiles that
    only it can explain (initials, nicknames, typing errors). This goes on until nothing merges. A numbered mailbox
    beside the unnumbered one of the same domain is a namesake and takes no part by name.

    Result: ident ("author <email>" exactly as written), person (smallest ident of the person). Null author or email:
    left out. Role and machine accounts are no persons. A bare login is one only if it is the login of an address that
    stands beside a full name. Repeated rows count once. Empty input: no rows.
    """
    distinct = rows.where(F.col(author).isNotNull() & F.col(email).isNotNull()).groupBy(F.col(author).alias("a"), F.col(email).alias("e")).agg(F.count(F.lit(1)).alias("n"))
    facts = distinct.select(ident_of("a", "e").alias("id"), _evidence("a", "e").alias("v")).select("id", "v.*").where(~F.col("role"))
    facts = cut(facts)
    boxes = facts.select(F.explode("strong").alias("base")).distinct().withColumn("stands", F.lit(True))
    facts = _left(facts, boxes, "base", F.col("base").isNotNull()).withColumn("namesake", F.coalesce("stands", F.lit(False)))
    logins = facts.where((F.col("kind") == "full") & (F.col("handle") != "")).select(F.col("handle").alias("login")).distinct().withColumn("owned", F.lit(True))
    facts = _left(facts, logins, "login", F.col("kind") == "login").where((F.col("kind") != "login") | F.coalesce("owned", F.lit(False)))
    none = F.array().cast("array<string>")
    facts = cut(facts.select("id", "strong", "initial", "confirmed", F.when(F.col("namesake"), none).otherwise(F.col("names")).alias("open_names")))

    name_keys = F.transform("open_names", lambda n: F.concat(F.lit("n:"), n))
    keys = cut(facts.select("id", F.explode(F.concat("strong", name_keys)).alias("key")))
    labels = components(keys, facts.select("id", F.col("id").alias("label")))
    while True:
        links = cut(_weak_links(_profiles(facts, labels)))
        if not links.limit(1).count():
            break
        more = links.select(F.col("label").alias("id"), F.concat(F.lit("l:"), "to").alias("key")).unionByName(links.select(F.col("to").alias("id"), F.concat(F.lit("l:"), "to").alias("key")))
        keys = cut(keys.unionByName(more))
        labels = components(keys, labels)
    return labels.select(F.col("id").alias("ident"), F.col("label").alias("person"))


def ident_of(author: str, email: str):
    """An identity exactly as written."""
    return F.concat(F.col(author), F.lit(" <"), F.col(email), F.lit(">"))


def identity_pairs(people: DataFrame) -> DataFrame:
    """All pairs of identities of one person, smaller string first."""
    a = people.select("person", F.col("ident").alias("ident_a"))
    b = people.select("person", F.col("ident").alias("ident_b"))
    return a.join(b, "person").where(F.col("ident_a") < F.col("ident_b")).select("ident_a", "ident_b")
