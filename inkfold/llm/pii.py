"""Surrogates for personal data.

Found entities (mail addresses, phone numbers, IPv4 addresses, card and account numbers, identity numbers, IBANs, names
after a form of address or with a known given name) are replaced by keyed surrogates of the same type and format. Letters
stay letters of their script, case and kind (vowel or not) and digits stay digits, by a keyed Feistel network over the
entity's own letters and digits. It permutes the entities of one format, so different ones stay different at any scale,
and equal ones get equal surrogates in all documents, however they are capitalised or spaced. Card numbers keep a valid
or invalid check digit, addresses stay in range, phone numbers keep the country code, and given names move along a circle of
those of the same gender and script, whose order the key alone tells. Where formats could still meet (a name from the list and a permuted one), a check
over the distinct entities of all documents finds surrogates that fall together, and re-keys them. The key has no default:
who holds it can undo the surrogates, so it is the caller's secret.

Everything is SQL functions on the rows where they are; only distinct entities are shuffled, pre-aggregated.
Null texts stay null. Texts without entities are kept as they are, byte for byte. Very long texts are searched whole. Where two
types begin at one place, the first of PATTERNS wins; of two spellings that ignore case the lesser is the one that is checked
for collisions. Repeated rows give repeated rows; an empty table gives none. Extra columns are kept, whatever their names; a
column named n_pii is replaced.
"""

from __future__ import annotations

import hmac
import secrets

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkfold.llm.common import dropped, fresh_name, stored

#: The session's setting that holds the key.
KEY_CONF = "spark.inkfold.pii.key"
ROUNDS = 4
#: New keys for surrogates that fall together, at most, and re-keyed entities that a plan holds as a map.
ATTEMPTS, IN_PLAN = 40, 2_000

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Carmen Charlotte Claire Elena Elizabeth Emily Emma Eva Hannah Ingrid Isabel Jane Jennifer Julia Karin Laura Linda Lucia Maria Marie Martha Mary Monika Nancy Nora Olivia Patricia Paula Petra Rosa Ruth Sabine Sarah Sofia Sophie Susan Ursula".split(),
    ("latin", "m"): "Albert Alexander Andreas Antonio Carlos Charles Daniel David Diego Edward Felix Fernando Frank George Hans Henry Jack James Jean John Jorge Joseph Juan Klaus Lucas Luis Manuel Mark Martin Michael Miguel Paul Peter Pierre Robert Samuel Stefan Thomas Walter William".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Надежда Наталья Ольга Светлана Софья Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Борис Виктор Дмитрий Иван Игорь Михаил Николай Павел Пётр Сергей".split(),
}
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Lady|Herr|Frau|Monsieur|Madame|Mademoiselle|Mme|Mlle|Señora|Señor|Señorita|Sra|Sr|Don|Doña|Господин|Госпожа|г-н|г-жа"
_NAMES = "|".join(n for own in GIVEN.values() for n in own)
_LAST = r"\p{Lu}[\p{L}'’\-]+"

#: Types in order of precedence where two begin at the same place.
PATTERNS = [
    ("email", r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?)+"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9])"),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{1,4}|[0-9]{13,19})(?![0-9A-Za-z])"),
    ("identity", r"(?<![0-9A-Za-z])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])"),
    ("name", rf"(?=\p{{Lu}}|г-)(?<![\p{{L}}\p{{N}}])(?:(?:{TITLES})\.?[ ]{{1,2}}{_LAST}(?:[ ]{_LAST})?|(?:{_NAMES})[ ]{_LAST})(?![\p{{L}}\p{{N}}])"),
]
ENTITY = "|".join(f"(?:{p})" for _, p in PATTERNS)

#: Characters move within one of these.
ALPHABETS = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àâäáèéêëìíîïòóôöùúûü", "çñß", "ÀÂÄÁÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "ÇÑẞ",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
ALL = "".join(ALPHABETS)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _text(parts: Column) -> Column:
    return F.array_join(parts, "")


def _moved(text: Column, stream: Column) -> Column:
    """Each character of text moved within its alphabet by hex digits of stream; other characters stay."""
    first = F.split(F.lit(",".join(str(ALL.index(letters)) for letters in ALPHABETS for _ in letters)), ",")
    size = F.split(F.lit(",".join(str(len(letters)) for letters in ALPHABETS for _ in letters)), ",")

    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(stream, (i % 31) * 2 + 1, F.lit(4)), 16, 10).cast("int")
        at = F.struct(F.instr(F.lit(ALL), c).alias("at"), by.alias("by"))
        return _let(at, lambda x: F.when(x["at"] > 0, put(x["at"], x["by"])).otherwise(c))

    def put(at: Column, by: Column) -> Column:
        start = F.element_at(first, at).cast("int")
        return F.substring(F.lit(ALL), start + (at - 1 - start + by) % F.element_at(size, at).cast("int") + 1, F.lit(1))

    return F.when(text == "", text).otherwise(_text(F.transform(F.split(text, ""), one)))


def _stream(key: Column, salt: Column, of: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, salt, F.lower(of)), 256)


def _round(k: int, move, salt: Column):
    """One round of a Feistel network over struct<a, b>: a part moves by what the other says."""

    def odd(s: Column) -> Column:
        return F.struct(move(s["a"], s["b"], F.concat(salt, F.lit(str(k)))).alias("a"), s["b"].alias("b"))

    def even(s: Column) -> Column:
        return F.struct(s["a"].alias("a"), move(s["b"], s["a"], F.concat(salt, F.lit(str(k)))).alias("b"))

    return odd if k % 2 else even


def permuted(text: Column, key: Column, salt: Column) -> Column:
    """A keyed permutation of texts of one shape (the classes of their characters, in order)."""
    half = (F.length(text) / 2).cast("int")
    state = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    for k in range(ROUNDS):
        state = _let(state, _round(k, lambda part, other, salt: _moved(part, _stream(key, salt, other)), salt))
    return _let(state, lambda s: F.concat(s["a"], s["b"]))


def _refilled(shape: Column, letters: Column) -> Column:
    """shape with its letters and digits replaced, in order, by those of letters."""
    step = F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(
            c.rlike(r"[\p{L}\p{N}]"),
            F.struct(F.concat(s["out"], F.substring(letters, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )
    return F.when(shape == "", shape).otherwise(step)


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def _luhn(body: Column) -> Column:
    """The check digit of a run of digits."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int"))),
        F.lit(0),
        lambda s, x: s + F.when(x > 9, x - 9).otherwise(x),
    )
    return F.pmod(-total, F.lit(10))


def _ip(text: Column, key: Column) -> Column:
    octets = F.transform(F.split(text, "\\."), lambda x: x.cast("int"))
    state = _let(octets, lambda o: F.struct((o[0] * 256 + o[1]).alias("a"), (o[2] * 256 + o[3]).alias("b")))

    def move(part: Column, other: Column, salt: Column) -> Column:
        by = F.conv(F.substring(_stream(key, salt, other.cast("string")), 1, 4), 16, 10).cast("int")
        return (part + by) % 65536

    for k in range(ROUNDS):
        state = _let(state, _round(k, move, F.lit("ip")))
    parts = lambda n: [F.floor(n / 256).cast("string"), (n % 256).cast("string")]
    return _let(state, lambda s: F.concat_ws(".", *parts(s["a"]), *parts(s["b"])))


def session_key(spark: SparkSession) -> str:
    """The key that the session is set to; one is drawn for the session if it has none."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        key = secrets.token_hex(24)
        spark.conf.set(KEY_CONF, key)
    return key


def _given(word: Column, key: str, attempt: Column) -> Column:
    """A listed given name, moved on in its list, which the key has put in order; null for other words."""
    out = F.lit(None).cast("string")
    for (script, gender), names in GIVEN.items():
        circle = sorted(names, key=lambda n: hmac.digest(key.encode(), f"{script}|{gender}|{n}".encode(), "sha256"))
        listed, n = F.split(F.lit(" ".join(circle)), " "), len(circle)
        at = F.array_position(listed, word).cast("int")
        out = F.when(at > 0, F.element_at(listed, (at + attempt % (n - 1)) % n + 1)).otherwise(out)
    return out


def type_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS[:-1]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _part(text: Column, way: str | Column) -> Column:
    return F.struct(text.alias("text"), (F.lit(way) if isinstance(way, str) else way).alias("way"))


def _parts(entity: Column, kind: Column) -> Column:
    """The entity cut into parts, each with the way to replace it; way keep: it stays."""
    domain, country = F.regexp_extract(entity, "@(.*)$", 1), r"^\+[0-9]{1,3}"
    mail = F.array(
        _part(F.regexp_extract(entity, "^(.*)@", 1), "local"), _part(F.lit("@"), "keep"),
        _part(F.regexp_extract(domain, r"^(.*)\.", 1), "domain"), _part(F.regexp_extract(domain, r"\.[^.]*$", 0), "keep"),
    )
    phone = F.array(_part(F.regexp_extract(entity, country, 0), "keep"), _part(F.regexp_replace(entity, country, ""), "phone"))
    iban = F.array(_part(F.substring(entity, 1, 2), "keep"), _part(F.substring(entity, F.lit(3), F.length(entity)), "iban"))
    way = lambda w: F.when(w.rlike(rf"^(?:{TITLES})\.?$|^ ?$"), "keep").otherwise("name")
    name = F.transform(F.split(entity, "(?<= )|(?= )"), lambda w: _part(w, way(w)))
    made = F.when(kind == "email", mail).when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "name", name)
    return made.otherwise(F.array(_part(entity, kind)))


def _replaced(part: Column, key: str, attempt: Column | None) -> Column:
    text, way = part["text"], part["way"]
    # the attempt is part of the key
    secret, attempt = (F.lit(key), F.lit(0)) if attempt is None else (F.concat(F.lit(f"{key}#"), attempt.cast("string")), attempt)
    # a card's last digit follows from the others and from how far it was off
    body = lambda bare: F.when(way == "card", F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)
    off = lambda bare, old: F.substring(bare, -1, 1).cast("int") - _luhn(old)
    last = lambda bare, old, new: F.when(way == "card", F.pmod(_luhn(new) + off(bare, old), F.lit(10)).cast("string")).otherwise(F.lit(""))
    shaped = _let(
        _let(_bare(text), lambda bare: F.struct(bare.alias("bare"), body(bare).alias("old"))),
        lambda x: _let(permuted(x["old"], secret, way), lambda new: _refilled(text, F.concat(new, last(x["bare"], x["old"], new)))),
    )
    named = F.coalesce(F.when(way == "name", _given(text, key, attempt)), shaped)
    return F.when((way == "keep") | (text == ""), text).when(way == "ip", _ip(text, secret)).otherwise(named)


def surrogate(entity: Column, key: str, attempt: Column | None = None) -> Column:
    """The surrogate of an entity (as PATTERNS finds it); attempt: how often it was re-keyed, if it was."""
    if not key:
        raise ValueError("surrogates need a key")
    parts = _let(type_of(entity), lambda kind: _parts(entity, kind))
    return _text(F.transform(parts, lambda part: _replaced(part, key, attempt)))


def entities(text: Column) -> Column:
    """All entities of a text, in order, repeated as they come; empty for null."""
    # cheaper tests come first: all types but names hold @ or a digit
    some = (text.rlike("[0-9@]") & text.rlike(ENTITY)) | text.rlike(PATTERNS[-1][1])
    return F.when(F.coalesce(some, F.lit(False)), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def rekeyed(documents: DataFrame, key: str) -> DataFrame:
    """entity, replacement: of the entities whose surrogates fall together with another's, new ones that don't."""
    found = documents.select(F.explode(F.array_distinct(entities(F.col("text")))).alias("entity"))
    # one row for each spelling that ignores case
    known = stored(found.groupBy(F.lower("entity").alias("entity_key")).agg(F.min("entity").alias("entity")), "entities")
    made = stored(known.select("entity_key", "entity", F.lit(0).alias("attempt"), surrogate(F.col("entity"), key).alias("replacement")), "surrogates")
    dropped(known)
    for _ in range(ATTEMPTS):
        target = F.lower("replacement").alias("target")
        shared = made.groupBy(target).agg(F.count("*").alias("n"), F.min("entity_key").alias("keeps")).where("n > 1")
        bad = made.withColumn("target", target).join(shared, "target").where("entity_key <> keeps").select("entity_key")
        bad = stored(bad, "collisions")
        if bad.isEmpty():
            dropped(bad)
            return made.where("attempt > 0").select("entity_key", "replacement")
        again = made.join(bad.withColumn("again", F.lit(1)), "entity_key", "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        new = surrogate(F.col("entity"), key, F.col("attempt"))
        following = stored(again.select("entity_key", "entity", "attempt", F.when(F.col("again") == 1, new).otherwise(F.col("replacement")).alias("replacement")), "surrogates")
        dropped(bad)
        dropped(made)
        made = following
    raise RuntimeError(f"surrogates still fall together after {ATTEMPTS} new keys")


def redact(documents: DataFrame, key: str) -> DataFrame:
    """documents with entities in `text` replaced and their number as n_pii."""
    changed = rekeyed(documents, key)
    columns = [c for c in documents.columns if c.lower() != "n_pii"]
    digest, swaps, found = (fresh_name(documents, n) for n in ("digest", "swaps", "found"))
    own = documents.select(*[F.col(f"`{c}`") for c in columns])
    few = changed.limit(IN_PLAN + 1).collect()
    if not few:
        swap = lambda m: surrogate(m, key)
    elif len(few) <= IN_PLAN:
        new = F.create_map(*[F.lit(x) for r in few for x in (r["entity_key"], r["replacement"])])
        swap = lambda m: F.coalesce(F.try_element_at(new, F.lower(m)), surrogate(m, key))
    else:
        # texts are joined by digest to the new surrogates of their entities; null texts are spread, as they have none
        of = F.coalesce(F.when(F.col("text").isNotNull(), F.xxhash64("text")), F.monotonically_increasing_id())
        pairs = documents.where("text is not null").select(of.alias(digest), F.explode(F.array_distinct(entities(F.col("text")))).alias("entity")).distinct()
        maps = pairs.join(changed, F.lower("entity") == F.col("entity_key")).groupBy(digest).agg(F.map_from_entries(F.collect_list(F.struct("entity", "replacement"))).alias(swaps))
        own = own.withColumn(digest, of).join(maps, digest, "left").drop(digest)
        swap = lambda m: F.coalesce(F.try_element_at(F.col(swaps), m), surrogate(m, key))
    text = F.col("text")
    own = own.withColumn(found, entities(text))
    parts = F.split(text, ENTITY, -1)
    woven = _text(F.flatten(F.zip_with(parts, F.transform(found, swap), lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))))
    out = own.withColumn("text", F.when(F.size(found) > 0, woven).otherwise(text)).withColumn("n_pii", F.size(found))
    return out.select(*[F.col(f"`{c}`") for c in columns], "n_pii")
