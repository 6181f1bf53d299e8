"""Surrogates for personal data: keyed, type-consistent, distinct and the same for the same entity everywhere.

One pass finds entities; names fall into their words (given names, the surname), so that a full name, a title with the
surname and the bare surname later in the document stay the same person. The distinct canonical forms (digits of a number,
a lower-case address, a word of a name with its gender) are one table; each gets a surrogate from its HMAC-SHA-512 under a
secret key. The key reaches the executors as data, a row a round, and stands in no plan. Surrogates that meet another's, or an
original of their type, are made again with the next attempt until none is left: distinct entities stay distinct. The text
then gets each surrogate in the written form of the place: separators, country codes, letter case, titles, gender and script stay.
Mentions of a full name, a surname or a given name without the title, anywhere in a document that holds the name with one, get
its surrogate too (a given name not where another capitalised word follows: that is somebody else); n_entities does not
count them. Each number of an address is 255 at most.

Hosts keep their last label and get 12 keyed hexadecimal digits; initials become other initials and need not be distinct.

Defined cases: null and empty texts come back as they are; a text without entities too; repeated rows are treated alike;
other columns pass through, also with the names used here (n_entities is replaced); an empty table gives no rows; a type
whose forms run out (more entities than ten-digit numbers, say) is an error; texts of any length are searched whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, row_key, table, unpacked, whole_row

# Titles by the gender they show.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mademoiselle", "Госпожа"]
MALE_TITLES = ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин"]
OTHER_TITLES = ["Dr", "Prof"]
# Syllables of made names, and the endings of given names by gender (f, m, not shown).
SYLLABLES = {
    "latin": "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro ta te ti to".split(),
    "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро та те ти то".split(),
}
ENDINGS = {"latin": {"f": "na", "m": "rd", "n": "l"}, "cyrillic": {"f": "на", "m": "рд", "n": "ль"}}
# Country codes of one digit and of two; all others have three.
ONE_DIGIT, TWO_DIGITS = "[17]", "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _titles(titles: list[str]) -> str:
    """As written, or in capitals."""
    return "|".join(t for x in titles for t in dict.fromkeys((x, x.upper())))


TITLE = _titles(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)
#: A capitalised word of a name, or initials.
WORD = r"\p{Lu}(?:\.(?:\p{Lu}\.)*+|[\p{L}'\-]*+)"
SECRET = r"[A-Za-z0-9+/_\-]"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|\d{1,2})"
HOST_LABEL = r"[A-Za-z0-9\-]{1,63}"
PATTERNS = {
    "secret": rf"""(?:(?i)token|secret|password|passwd|api[_-]?key)\s{{0,3}}[=:]\s{{0,3}}["']?(?={SECRET}(?:\.?{SECRET}){{15}}){SECRET}++(?:\.{SECRET}++)*+""",
    "email": rf"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{{0,63}}@{HOST_LABEL}(?:\.{HOST_LABEL}){{0,4}}\.[A-Za-z]{{2,24}}",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "card": r"(?<![\d])(?:\d{4}[ \-]?){3}\d{4}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w\-])\d{3}-\d{3}-\d{4}(?![\d\-])",
    "name": rf"(?<![\p{{L}}])(?:{TITLE})\.? {WORD}(?: (?!(?:{TITLE})\b){WORD})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
TITLE_FIRST = rf"^(?:{TITLE})\.? "
INITIALS = r"^(\p{L}\.)+$"
BLOCK = 128  # bytes of a block of SHA-512


def _byte(i: str) -> str:
    """A byte 0 to 255 of the hash h; i from 0."""
    return f"cast(conv(substring(h, 1 + 2 * (({i}) % 64), 2), 16, 10) as int)"


def _each(value: str, body: str) -> str:
    """body for each i from 1 to the length of value, joined; nothing for an empty value."""
    return f"if({value} = '', '', array_join(transform(sequence(1, greatest(length({value}), 1)), i -> {body}), ''))"


def _letters(value: str) -> str:
    """value with letters and digits replaced by others of their kind."""
    c = f"substring({value}, i, 1)"
    one_of = lambda letters: f"substring('{letters}', 1 + {_byte('i')} % {len(letters)}, 1)"
    small = "abcdefghijklmnopqrstuvwxyz"
    return _each(
        value,
        f"case when {c} rlike '[0-9]' then {one_of('0123456789')} when {c} rlike '[a-f]' and {value} rlike '^[0-9a-f]+$' then {one_of('abcdef')} "
        f"when {c} rlike '[a-z]' then {one_of(small)} when {c} rlike '[A-Z]' then {one_of(small.upper())} else {c} end",
    )


def _luhn(digits: str) -> str:
    """Luhn sum of digits with the last at even weight 1."""
    d = f"cast(substring({digits}, i, 1) as int)"
    doubled = f"if((length({digits}) - i) % 2 = 0, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d}))"
    return f"aggregate(transform(sequence(1, length({digits})), i -> {doubled}), 0, (a, x) -> a + x)"


def _by_script(choice: dict[str, str]) -> str:
    return f"if(script = 'cyrillic', {choice['cyrillic']}, {choice['latin']})"


def _surrogate() -> Column:
    """Of kind, canon, gender, script, attempt and the hash h; host_h is the hash of the host of an address."""
    digits = _each("canon", f"cast({_byte('i')} % 10 as string)")
    stem = f"concat(substring(canon, 1, 1), substring({digits}, 2, 14))"
    check = f"cast((10 - {_luhn(f'concat({stem}, 0)')} % 10) % 10 as string)"
    card = f"concat({stem}, if({_luhn('canon')} % 10 = 0, {check}, substring({digits}, 16, 1)))"
    ip = f"concat_ws('.', transform(sequence(1, 4), i -> cast(1 + {_byte('i')} % 254 as string)))"
    # short local parts get letters more once they have met others
    local = f"concat({_letters("substring_index(canon, '@', 1)")}, if(attempt > 2, substring(translate(h, '0123456789', 'ghijklmnop'), 1, attempt), ''))"
    email = f"concat({local}, '@h', substring(host_h, 1, 12), '.example.', substring_index(canon, '.', -1))"
    syllable = _by_script({s: f"element_at(array({', '.join(map(repr, v))}), 1 + {_byte('i')} % {len(v)})" for s, v in SYLLABLES.items()})
    made = lambda n: f"array_join(transform(sequence(1, {n} + attempt), i -> {syllable}), '')"
    ending = _by_script({s: f"case gender when 'f' then '{v['f']}' when 'm' then '{v['m']}' else '{v['n']}' end" for s, v in ENDINGS.items()})
    initials = _each("canon", f"if(substring(canon, i, 1) = '.', '.', substring({_by_script({'latin': repr('ABCDEFGHIKLMNOPRSTUVW'), 'cyrillic': repr('АБВГДЕЖЗИКЛМНОПРСТУФ')})}, 1 + {_byte('i')} % 20, 1))")
    code = f"case when canon rlike '^[+]{ONE_DIGIT}' then 2 when canon rlike '^[+]({TWO_DIGITS})' then 3 when canon like '+%' then 4 else 1 end"
    phone = f"concat(substring(canon, 1, {code}), substring({digits}, {code} + 1))"
    kinds = {"card": card, "ip": ip, "email": email, "phone": phone, "ssn": digits, "surname": f"initcap({made(3)})", "given": f"initcap(concat({made(2)}, {ending}))", "initials": initials}
    return F.expr("case kind " + " ".join(f"when '{k}' then {v}" for k, v in kinds.items()) + f" else {_letters('canon')} end")


def _keys(key: bytes, rounds: int) -> list[tuple[int, bytearray, bytearray]]:
    """(attempt, inner block, outer block) of the HMAC for each round."""
    block = (hashlib.sha512(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return [(n, bytearray(b ^ 0x36 for b in block), bytearray(b ^ 0x5C for b in block)) for n in range(rounds)]


def _hmac(message: Column) -> Column:
    """HMAC-SHA-512 in hexadecimal, of the columns inner and outer."""
    return F.sha2(F.concat("outer", F.unhex(F.sha2(F.concat("inner", message.cast("binary")), 512))), 512)


def entities(docs: DataFrame) -> DataFrame:
    """(k1, k2, pos, found, whole): each detected entity, pos counting from 0 in its text; whole is its type."""
    at = docs.where("text is not null").select(*row_key("doc_id", "text"), F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("pos", "found"))
    kind = F.lit("name")
    for k in ("phone", "ssn", "card", "ip", "email", "secret"):
        kind = F.when(F.col("found").rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(kind)
    return at.withColumn("whole", kind)


def parts(found: DataFrame) -> DataFrame:
    """found by (part, written, kind, canon, gender, script): a name gives a row for each word, all others one row."""
    bare = F.regexp_replace("found", TITLE_FIRST, "")
    written = F.when(F.col("whole") == "name", F.split(bare, " ")).otherwise(F.array("found"))
    at = found.select("*", F.size(written).alias("n_parts"), F.posexplode(written).alias("part", "written"))
    last = F.col("part") == F.col("n_parts") - 1
    word = F.when(F.col("written").rlike(INITIALS), "initials").when(last, "surname").otherwise("given")
    at = at.withColumn("kind", F.when(F.col("whole") == "name", word).otherwise(F.col("whole")))
    gender = F.when(F.col("kind") != "given", "n").when(F.col("found").rlike(rf"^(?:{_titles(FEMALE_TITLES)})\b"), "f")
    gender = gender.when(F.col("found").rlike(rf"^(?:{_titles(MALE_TITLES)})\b"), "m").otherwise("n")
    number = F.concat(F.when(F.col("written").startswith("+"), "+").otherwise(""), F.regexp_replace("written", "[^0-9]", ""))
    secret = F.regexp_extract("written", r"[A-Za-z0-9+/_.\-]+$", 0)
    canon = F.when(F.col("kind").isin("phone", "ssn", "card"), number).when(F.col("kind") == "secret", secret).otherwise(F.lower("written"))
    script = F.when(F.col("written").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return at.withColumns({"canon": canon, "gender": gender, "script": script})


def surrogates(found: DataFrame, key: str | bytes, max_rounds: int = 60) -> DataFrame:
    """(kind, canon, gender, surrogate) of found (rows of parts): one row for each distinct entity.

    No two surrogates of a type are alike and none is an original; given names and surnames are one type, initials are none.
    """
    key = key.encode() if isinstance(key, str) else key
    spark = found.sparkSession
    keys = F.broadcast(spark.createDataFrame(_keys(key, max_rounds), "attempt int, inner binary, outer binary"))
    space = F.when(F.col("kind").isin("given", "surname"), "name").otherwise(F.col("kind")).alias("space")
    distinct = table(found.groupBy("kind", "canon", "gender").agg(F.min("script").alias("script")).select("*", space), "entities")
    own = distinct.withColumn("attempt", F.lit(0))
    originals = own.select(F.col("space").alias("o_space"), F.col("canon").alias("o_canon")).distinct()
    old = []
    for _ in range(max_rounds):
        made = own.join(keys, "attempt").withColumn("h", _hmac(F.concat_ws("|", "kind", "canon", "gender", F.col("attempt").cast("string"))))
        made = made.withColumn("host_h", F.when(F.col("kind") == "email", _hmac(F.concat(F.lit("host|"), F.substring_index("canon", "@", -1)))))
        made = made.withColumn("surrogate", _surrogate()).drop("h", "host_h", "inner", "outer")
        clash = (F.col("space") == F.col("o_space")) & (F.lower("surrogate") == F.col("o_canon"))
        again = "kind <> 'initials' and (o_canon is not null or row_number() over (partition by space, lower(surrogate) order by attempt, canon, gender) > 1) as again"
        made = table(made.join(originals, clash, "left").selectExpr("kind", "canon", "gender", "script", "space", "attempt", "surrogate", again), "made")
        drop_tables(*old)
        old = [made]
        if made.where("again").isEmpty():
            drop_tables(distinct)
            return made.select("kind", "canon", "gender", "surrogate")
        own = made.selectExpr("kind", "canon", "gender", "script", "space", "attempt + cast(again as int) as attempt")
    raise RuntimeError("surrogates of a type ran out")


def _written() -> Column:
    """The surrogate as the part was written."""
    nth = "length(regexp_replace(substring(written, 1, i), '[^0-9]', ''))"
    digits = _each("written", f"if(substring(written, i, 1) rlike '[0-9]', substring(regexp_replace(surrogate, '[^0-9]', ''), {nth}, 1), substring(written, i, 1))")
    cased = "if(written = upper(written) and (length(written) > 1 or kind <> 'surname'), upper(surrogate), surrogate)"
    return F.expr(f"case when kind in ('phone', 'ssn', 'card') then {digits} when kind = 'secret' then replace(written, canon, surrogate) when kind in ('email', 'given', 'surname', 'initials') then {cased} else surrogate end")


def replace_entities(docs: DataFrame, key: str | bytes) -> DataFrame:
    """docs with each entity replaced in text, and a long column n_entities."""
    found = table(parts(entities(docs)), "found")
    made = surrogates(found, key)
    put = found.join(made, ["kind", "canon", "gender"]).withColumn("put", _written())
    words = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), " ")
    put = put.groupBy("k1", "k2", "pos", "found", "whole").agg(F.sort_array(F.collect_set(F.struct("part", "written", "put", "kind"))).alias("parts"))
    put = put.withColumns({"name": words("written"), "to": words("put"), "last": F.element_at("parts", -1)})
    title = F.when(F.col("whole") == "name", F.regexp_extract("found", TITLE_FIRST, 0)).otherwise("")
    # full names and surnames of more than initials, the longest first, for their mentions without a title
    mention = lambda a, b, alone=False: F.struct((-F.length(a)).alias("order"), a.alias("bare"), b.alias("to"), F.lit(alone).alias("alone"))
    given = F.transform(F.filter("parts", lambda p: (p["kind"] == "given") & p["written"].rlike(r"\p{L}{2}")), lambda p: mention(p["written"], p["put"], True))
    full, surname = mention(F.col("name"), F.col("to")), mention(F.col("last.written"), F.col("last.put"))
    is_name = (F.col("whole") == "name") & (F.col("last.kind") == "surname") & F.col("last.written").rlike(r"\p{L}{2}")
    put = put.select("k1", "k2", F.struct("pos", F.concat(title, "to").alias("put")).alias("at"), F.when(is_name, F.concat(F.array(full, surname), given)).alias("names"))
    put = put.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("at")).alias("puts"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"))
    put = put.select("k1", "k2", F.col("puts.put").alias("puts"), "names")
    own = [c for c in docs.columns if c not in ("text", "n_entities")]
    j = docs.select(whole_row(docs).alias("row"), *row_key("doc_id", "text")).join(put.hint("shuffle_hash"), ["k1", "k2"], "left")
    of = lambda n: F.concat(F.lit(r"(?<![\p{L}])\Q"), n["bare"], F.when(n["alone"], r"\E(?![\p{L}]|-\p{L}| \p{Lu})").otherwise(r"\E(?![\p{L}])"))
    pieces = F.transform(F.split("row.text", ANY, -1), lambda p: F.aggregate("names", p, lambda x, n: F.regexp_replace(x, of(n), n["to"])))
    text = F.concat(F.array_join(F.zip_with(F.slice(pieces, 1, F.size("puts")), "puts", lambda a, b: F.concat(a, b)), ""), F.element_at(pieces, -1))
    changed = F.when(F.col("puts").isNull(), F.col("row.text")).otherwise(text)
    made = j.select("row", changed.alias("new_text"), F.coalesce(F.size("puts"), F.lit(0)).cast("long").alias("n"))
    return made.select(*unpacked("row", own), F.col("new_text").alias("text"), F.col("n").alias("n_entities"))
