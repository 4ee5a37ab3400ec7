"""PII surrogates, DataFrame operations only: detected entities get keyed, type-consistent replacements.

One pattern finds the entities of a text. Each is brought to a canonical form (digits of a card or phone, lower-cased
address, words of a name). The distinct canonical forms of the whole corpus make one table, where each draws a
surrogate from a keyed digest: digits for digits, letters of the same script and case for letters, octets for octets,
names of the same gender and script for names; card numbers keep their Luhn validity. Two entities that draw the same
surrogate, or one that draws an entity which occurs, draw again until none collides, names with more syllables each
other time, so different entities stay different and the same entity is replaced alike everywhere. Surrogates are then
poured into each occurrence's format. Names are found after a title. The key comes from the session.

Only texts with entities are shuffled, by their digest; the others pass through. Entities are made distinct with
map-side pre-aggregation, and the joins back are inner equi-joins against one row a key.

Defined cases: null text stays null; null ids keep their row; empty texts, repeated rows and extra columns are kept as
they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, read, saved

#: The key where none is given; not a secret. ``KEY_SETTING`` names the session setting that holds the real one.
KEY, KEY_SETTING = "change-me", "spark.docframe.pii.key"
_SECRET_LEAD = r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)[\"']? ?[=:]{1,2} ?[\"']?"
_MEN = r"Mr|Sir|Herr|Señor|Monsieur|Г-н|Господин"
_WOMEN = r"Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mademoiselle|Г-жа|Госпожа"
_GENDERLESS = r"Dr|Prof|Professor|Doctor|Docteur|Doktor"
#: Names may have capitals, apostrophes and hyphens within. After a German title the third word may be any noun, so it is no name.
_NAME = r"\p{Lu}(?:['’](?=\p{Lu}))?(?:\p{L}(?:['’](?=\p{Lu}))?){1,30}+(?:-\p{L}{1,30}+){0,2}+"
_NAMES = rf"{_NAME}(?: {_NAME}){{0,2}}"
_PEOPLE = ("man", "woman", "person")
#: Pattern of each entity type, in order of precedence; all are bounded or possessive, so no text makes them backtrack far.
PATTERNS: dict[str, str] = {
    "secret": rf"(?<![\p{{L}}\p{{N}}])(?i:{_SECRET_LEAD})[^\s\"',;]{{6,}}+|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{{16,}}+|gh[pousr]_[A-Za-z0-9]{{36,}}+|sk-[A-Za-z0-9]{{20,}}+)",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\d.+-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,5}){1,4}(?!\d)|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]{0,39}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "man": rf"(?<!\p{{L}})(?:Herr {_NAME}(?: {_NAME})?|(?:{_MEN})\.? {_NAMES})",
    "woman": rf"(?<!\p{{L}})(?:Frau {_NAME}(?: {_NAME})?|(?:{_WOMEN})\.? {_NAMES})",
    "person": rf"(?<!\p{{L}})(?:{_GENDERLESS})\.? {_NAMES}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity needs to hold: a digit, an at sign, a title or how a secret starts; tells most texts apart at little cost.
MAYBE = rf"[0-9@]|(?:{_MEN}|{_WOMEN}|{_GENDERLESS})\.? \p{{Lu}}|(?i:{_SECRET_LEAD})|AKIA|gh[pousr]_|sk-"
# Syllables that surrogate names are made of, by script; letters that surrogates draw from.
LATIN = "ba be bo da de do fa fe ga go ha he ja jo ka ke la le lo ma me mo na ne no pa po ra re ro sa se so ta te to va ve".split()
CYRILLIC = "ба бе бо ва ве да де до ка ле ла ма ми мо на не но ра ре ро са се та то".split()
ENDINGS = {("man", False): ["n", "r", "s", "rd"], ("woman", False): ["na", "lla", "ra", "nia"], ("person", False): ["l", "ly", "x", "be"], ("person", True): ["ль", "я", "ша", "и"], ("surname", False): ["ck", "nd", "lt", "mer", "son"], ("man", True): ["н", "р", "с", "м"], ("woman", True): ["на", "ла", "ра", "ня"], ("surname", True): ["енко", "ский", "юк", "их"]}
ALPHABETS = {r"[a-z]": "abcdefghijklmnopqrstuvwxyz", r"[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[а-яё]": "абвгдежзийклмнопрстуфхцчшщыэюя", r"[А-ЯЁ]": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ", r"[α-ω]": "αβγδεζηθικλμνξοπρστυφχψω", r"[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"[ß-öø-ÿ]": "àáâäèéêëìíîïòóôöùúûüçñ", r"[À-ÖØ-Þ]": "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜÇÑ", r"[\x{4E00}-\x{9FFF}]": "天地人山水火木金土日月風花雪雲雨春夏秋冬東西南北", r"[\x{3041}-\x{30FF}]": "あいうえおかきくけこさしすせそたちつてとなにぬねの", r"[\x{0621}-\x{064A}]": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", r"[\x{05D0}-\x{05EA}]": "אבגדהוזחטיכלמנסעפצקרשת", r"[\x{AC00}-\x{D7A3}]": "가나다라마바사아자차카타파하고노도로모보소오조초", r"[\x{0905}-\x{0939}]": "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह", r"[\x{0E01}-\x{0E2E}]": "กขคงจฉชซญดตถทธนบปผพฟภมยรลวสหอฮ"}
#: A letter, mark or digit that nothing is drawn for; forms with one get surrogates by rank, so none of it stays.
UNDRAWN = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^0-9{''.join(letters[1:-1] for letters in ALPHABETS)}]]"


def _byte(stream: Column, at: Column | int) -> Column:
    """The ``at``-th byte (from 0) of a hex stream."""
    return F.conv(F.substr(stream, (F.lit(at) * 2 + 1) if isinstance(at, int) else at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), number % len(values) + 1)


def _each(text: Column, change) -> Column:
    """Concatenates ``change(character, index from 0)`` over the characters of ``text``."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda i: change(F.substr(text, i + 1, F.lit(1)), i)), "")


def _stream(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    blocks = F.sequence(F.lit(0), F.floor(F.length(canonical) / 32).cast("int"))
    return F.array_join(F.transform(blocks, lambda k: F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), k.cast("string"), canonical).cast("binary"), 512)), "")


def _alike(stream: Column, char: Column, i: Column, hexadecimal: Column) -> Column:
    number = _byte(stream, i * 2) * 256 + _byte(stream, i * 2 + 1)
    out = F.when(char.rlike("[0-9]"), (number % 10).cast("string")).when(hexadecimal & char.rlike("[a-f]"), _pick(list("abcdef"), number))
    for letters, alphabet in ALPHABETS.items():
        out = out.when(char.rlike(letters), _pick(list(alphabet), number))
    return out.otherwise(char)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    back = F.reverse(digits)
    value = lambda i: F.substr(back, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i) % 10 + F.floor(value(i) / 10).cast("int")) % 10


def draw(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical form at an attempt."""
    stream = _stream(kind, canonical, attempt, key)
    hexadecimal = canonical.rlike("^[0-9a-f:]+$")
    plain = _each(canonical, lambda c, i: _alike(stream, c, i, hexadecimal))
    top = F.length(canonical) - F.locate(".", F.reverse(canonical)) + 1
    # Equal domains get equal surrogates; what tells addresses apart is before the at sign.
    at = F.locate("@", canonical)
    domain = _stream(F.lit("domain"), F.substr(canonical, at + 1, F.length(canonical)), F.lit(0), key)
    email = _each(canonical, lambda c, i: F.when(i + 1 >= top, c).when(i >= at, _alike(domain, c, i - at, F.lit(False))).otherwise(_alike(stream, c, i, F.lit(False))))
    octets = F.split(canonical, r"\.")
    # Octets keep their lengths; once that has failed often, any do.
    octet = lambda o, i: F.when(attempt >= 8, _byte(stream, i)).when(F.length(o) == 1, 1 + _byte(stream, i) % 9).when(F.length(o) == 2, 10 + _byte(stream, i) % 90).otherwise(100 + _byte(stream, i) % 156).cast("string")
    ip = F.array_join(F.transform(octets, octet), ".")
    last = F.length(canonical) - 1
    drawn = F.concat(F.substr(canonical, F.lit(1), F.lit(1)), F.substr(plain, F.lit(2), last))
    zeroed = F.concat(F.substr(drawn, F.lit(1), last), F.lit("0"))
    card = F.when((luhn_sum(canonical) == 0), F.concat(F.substr(drawn, F.lit(1), last), ((10 - luhn_sum(zeroed)) % 10).cast("string"))).otherwise(drawn)
    lead = F.when(F.length(canonical) >= 11, 1).otherwise(0)
    phone = F.concat(F.substr(canonical, F.lit(1), lead), F.substr(plain, lead + 1, F.length(canonical)))
    iban = F.concat(F.substr(canonical, F.lit(1), F.lit(2)), F.substr(plain, F.lit(3), F.length(canonical)))

    def name(which: str) -> Column:
        def made(cyrillic: bool) -> Column:
            syllables = CYRILLIC if cyrillic else LATIN
            longer = [F.when(attempt >= 2 * i, _pick(syllables, _byte(stream, 3 + i))).otherwise("") for i in range(1, 6)]
            return F.initcap(F.concat(*[_pick(syllables, _byte(stream, i)) for i in range(3)], *longer, _pick(ENDINGS[which, cyrillic], _byte(stream, 3))))

        return F.when(canonical.rlike("[а-яё]"), made(True)).otherwise(made(False))

    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban)
    for which in (*_PEOPLE, "surname"):
        out = out.when(kind == which, name(which))
    return out.otherwise(plain)


def kind_of(match: Column) -> Column:
    """The type of a match: that of the first pattern that fits the whole of it."""
    out = None
    for name, pattern in PATTERNS.items():
        fits = match.rlike(rf"\A(?:{pattern})\z")
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("secret")


def _parts(kind: Column, match: Column) -> Column:
    """Array of (type, canonical form) that a match is made of: one, or for names the given name and the surname."""
    # Where lower case has another length, places would shift: such a match is its own canonical form.
    low = F.when(F.length(F.lower(match)) == F.length(match), F.lower(match)).otherwise(match)
    words = F.split(low, " ")
    one = lambda k, c: F.array(F.struct(k.alias("kind"), c.alias("canonical")))
    # All words but the title; the last is the surname.
    count = F.size(words)
    names = F.transform(F.slice(words, F.lit(2), F.greatest(count - 1, F.lit(0))), lambda w, i: F.struct(F.when(i + 2 == count, "surname").otherwise(kind).alias("kind"), w.alias("canonical")))
    digits = F.regexp_replace(match, "[^0-9A-Za-z]", "")
    value = F.regexp_extract(match, rf"(?s)^(?:(?i:{_SECRET_LEAD}))?(.*)$", 1)
    return F.when(kind.isin(*_PEOPLE), names).when(kind.isin("card", "phone", "ssn", "iban"), one(kind, digits)).when(kind == "secret", one(kind, value)).otherwise(one(kind, low))


def _poured(kind: Column, match: Column, new: Column) -> Column:
    """The replacement of a match; ``new`` is the array of surrogates of its parts."""
    first = new[0]
    packed = _each(match, lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substr(first, F.length(F.regexp_replace(F.substr(match, F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c))
    cased = _each(match, lambda c, i: F.when(c != F.lower(c), F.upper(F.substr(first, i + 1, F.lit(1)))).otherwise(F.substr(first, i + 1, F.lit(1))))
    value = F.length(F.regexp_extract(match, rf"(?s)^(?:(?i:{_SECRET_LEAD}))?(.*)$", 1))
    secret = F.concat(F.substr(match, F.lit(1), F.length(match) - value), first)
    names = F.concat_ws(" ", F.split(match, " ")[0], new)
    ranked = F.startswith(first, F.concat(kind, F.lit("-"))) & (kind != "secret")
    return F.when(kind.isin(*_PEOPLE), names).when(ranked, first).when(kind.isin("card", "phone", "ssn", "iban"), packed).when(kind == "secret", secret).otherwise(cased)


def by_rank(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, new) for entities that can't be drawn: surrogates of their rank by a keyed digest, so no two are alike."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), "kind", "canonical").cast("binary"), 256)
    placed = entities.select("kind", "canonical", digest.alias("_d")).withColumn("_r", F.row_number().over(W.partitionBy("kind").orderBy("_d", "canonical")).cast("string"))
    name = F.initcap(F.concat(F.lit("x"), F.translate(F.concat(F.substr("_d", F.lit(1), F.lit(8)), F.lit("x"), "_r"), "0123456789", "bdgklmnprs")))
    new = F.concat_ws("-", "kind", F.substr("_d", F.lit(1), F.lit(16)), "_r")
    new = F.when(F.col("kind").isin(*_PEOPLE, "surname"), name).when(F.col("kind") == "email", F.concat(new, F.lit("@surrogate.invalid"))).otherwise(new)
    return placed.select("kind", "canonical", new.alias("new"))


def surrogates(entities: DataFrame, key: str = KEY, rounds: int = 50) -> DataFrame:
    """(kind, canonical, new) for distinct (kind, canonical); redraws until no two are alike and none is an entity.

    What holds nothing to draw, or still collides after ``rounds``, gets a surrogate by rank.
    """
    each = entities.select("kind", "canonical").distinct()
    # An email's last label is never drawn; names are made anew whatever they hold.
    own = F.when(F.col("kind") == "email", F.regexp_replace("canonical", r"\.[^.]*$", "")).otherwise(F.col("canonical"))
    fixed = ~F.col("kind").isin(*_PEOPLE, "surname") & (own.rlike(UNDRAWN) | ~own.rlike("|".join(["[0-9]", *ALPHABETS])))
    # A number of partitions of its own: entities are few bytes and much work.
    each = saved(each.repartition(partitions(entities.sparkSession), "kind", "canonical").withColumn("fixed", fixed), "pii-entities")
    fixed = each.filter("fixed").select("kind", "canonical")
    spread = each.filter("not fixed").select("kind", "canonical").repartition(partitions(entities.sparkSession), "kind", "canonical")
    now = saved(spread.withColumn("attempt", F.lit(0)).withColumn("new", draw(F.col("kind"), F.col("canonical"), F.lit(0), key)), "pii-drawn")
    taken = each.select(F.col("kind").alias("_k"), F.lower("canonical").alias("_c"))
    for _ in range(rounds):
        rank = F.row_number().over(W.partitionBy("kind", F.lower("new")).orderBy("canonical"))
        ranked = now.withColumn("_again", rank > 1)
        clash = ranked.join(taken, (F.col("kind") == F.col("_k")) & (F.lower("new") == F.col("_c")), "left_semi").select("kind", "canonical").union(ranked.filter("_again").select("kind", "canonical")).distinct()
        clash = saved(clash, "pii-clash")
        if clash.isEmpty():
            return now.select("kind", "canonical", "new").unionByName(by_rank(fixed, key))
        redo = now.join(clash, ["kind", "canonical"], "left_semi").withColumn("attempt", F.col("attempt") + 1).withColumn("new", draw(F.col("kind"), F.col("canonical"), F.col("attempt"), key))
        now = saved(now.join(clash, ["kind", "canonical"], "left_anti").unionByName(redo), "pii-drawn")
    # The last redraw was not held against the others yet.
    rank = F.row_number().over(W.partitionBy("kind", F.lower("new")).orderBy("canonical"))
    ranked = now.withColumn("_again", rank > 1).join(taken, (F.col("kind") == F.col("_k")) & (F.lower("new") == F.col("_c")), "left")
    ranked = saved(ranked.withColumn("_left", F.col("_again") | F.col("_c").isNotNull()).select("kind", "canonical", "new", "_left").distinct(), "pii-left")
    left = ranked.filter("_left").select("kind", "canonical").unionByName(fixed)
    return ranked.filter("not _left").select("kind", "canonical", "new").unionByName(by_rank(left, key))


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None, count: str | None = None) -> DataFrame:
    """``docs`` with entities of ``text`` replaced; ``count`` names an optional column with their number.

    Without a ``key`` that of the session's ``KEY_SETTING`` is taken.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    # The row travels as one column, so that none of its names can clash.
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    own = F.col("_row")[text]
    maybe = F.coalesce(own.rlike(MAYBE), F.lit(False))
    found = rows.withColumn("_m", F.when(maybe, F.regexp_extract_all(own, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>")))
    hits = saved(found.filter(F.size("_m") > 0).withColumn("_t", F.md5(own)), "pii-hits")
    matches = saved(hits.select(F.explode("_m").alias("match")).distinct().withColumn("kind", kind_of(F.col("match"))).withColumn("parts", _parts(F.col("kind"), F.col("match"))), "pii-matches")
    parts = matches.select("match", "kind", F.posexplode("parts").alias("at", "part")).select("match", F.col("kind").alias("whole"), "at", "part.*")
    drawn = surrogates(parts, key)
    new = parts.join(drawn, ["kind", "canonical"]).groupBy("match", "whole").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("new"))
    new = new.select("match", _poured(F.col("whole"), F.col("match"), F.col("new")).alias("put"))
    # Distinct (text, match) pairs, then one map a text.
    pairs = hits.select("_t", F.explode("_m").alias("match")).distinct().join(new, "match")
    maps = pairs.groupBy("_t").agg(F.map_from_entries(F.collect_list(F.struct("match", "put"))).alias("_map"))
    put = F.concat(F.transform("_m", lambda m: F.element_at("_map", m)), F.array(F.lit("")))
    filled = F.array_join(F.zip_with(F.split(own, PATTERN, -1), put, lambda a, b: F.concat(a, b)), "")
    extra = [F.size("_m").cast("long").alias(count)] if count else []
    changed = hits.join(maps, "_t").withColumn("_row", F.col("_row").withField(text, filled)).select("_row.*", *extra)
    none = F.coalesce(F.size(F.regexp_extract_all(own, F.lit(PATTERN), F.lit(0))) == 0, F.lit(True))
    same = rows.filter(~maybe | none).select("_row.*", *([F.lit(0).cast("long").alias(count)] if count else []))
    return same.unionByName(changed)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_entities): every document with its entities replaced."""
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")
