"""Operator 4: keyed surrogates for personal data, in DataFrame and SQL operations only.

Mentions of e-mail and network addresses (both IP versions), phone, card, bank-account and social-security numbers,
hexadecimal secrets, access keys, and names after a title, before a Chinese title or after a phrase that introduces one
are found by one pattern; other names are not. A mention is cut into parts, each with an identity (``canon``) that does
not depend on how it is written: case for addresses, punctuation for numbers, the country prefix of a phone number,
the title of a name. Each identity gets one surrogate from a keyed hash, of the same type and form:

* digits for digits, letters of the same script and case for letters; network octets of the same width, card numbers
  with a valid check digit if the original has one, hexadecimal digits for hexadecimal digits;
* names alternate consonants and vowels of their script; female given names end in "a", male ones in a consonant;
* domains keep their last label and are shared by the addresses in them; phone numbers keep their country prefix.

Two identities of a type never share a surrogate and no surrogate is a real identity of its type: those that would are
hashed again, and after some attempts grow longer (version 4 addresses become version 6), so that a filled space of
numbers ends no run, until none is left. All mentions of an identity, in any document and form, get its surrogate; a
given name without a gendered title is that of the gender it has elsewhere.

Mentions are found once for each text and replaced wherever the text occurs, whatever the row's id: rows need none.

Cases: null text stays null; empty texts and tables stay as they are; null and repeated ids and repeated rows are kept
each with the same replacement; other columns are kept as they are, but for one named like ``count_col``, which it
replaces; texts and secrets of any length are treated whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import Workspace

#: Titles and the gender they tell.
MALE = ("Mr", "Herrn", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Κύριος", "Κύριε", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Κυρία", "κυρία")
EITHER = ("Dr", "Prof", "Professor", "Dra")
HAN_MALE, HAN_FEMALE = ("先生",), ("女士", "小姐", "太太")
#: Frequent Chinese family names, and phrases that introduce a name.
HAN_FAMILY = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧"
CUES = ("[Mm]y name is", "Name:", "[Ss]igned(?: by)?:?", "[Rr]egards,", "[Ss]incerely,", "[Mm]ein Name ist", "[Ii]ch heiße", "[Jj]e m'appelle", "Nom:", "[Mm]e llamo", "Nombre:", "[Мм]еня зовут")
#: Vowels and consonants of the scripts of names, and letters that stand for any of a script.
SCRIPTS = {
    "latin": ("aeiou", "bdfgklmnprstvz"),
    "accented": ("áéíóúàèìòùâêîôûäëïöü", "ñçßşčšžřłń"),
    "cyrillic": ("аеиоу", "бвгдзклмнпрст"),
    "greek": ("αειου", "βγδζκλμνπρτ"),
    "han": ("安文明华林江", "王李张陈杨黄周吴"),
}
CLASSES = {"latin": "[a-z]", "cyrillic": "[\\u0400-\\u04FF]", "greek": "[\\u0370-\\u03FF]", "han": "[\\u4E00-\\u9FFF]", "accented": "\\p{L}"}

_IN, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_TITLE = rf"(?:(?:{'|'.join(sorted(MALE + FEMALE + EITHER, key=len, reverse=True))})\.? |(?:{'|'.join(CUES)})\s)"
_HAN_TITLE = f"(?:{'|'.join(HAN_MALE + HAN_FEMALE)})"
_HEX = "[0-9a-fA-F]{1,4}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[a-fA-F:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "secret": rf"{_IN}[0-9a-fA-F]{{32,}}{_END}",
    "key": rf"{_IN}(?:A(?:KI|SI)A[0-9A-Z]{{16}}|[sp]k[-_](?:[A-Za-z0-9]+[-_])*[A-Za-z0-9]{{16,}}|gh[opsu]_[A-Za-z0-9]{{30,}}|xox[abprs]-[A-Za-z0-9-]{{10,}}|AIza[0-9A-Za-z_-]{{35}}){_END}",
    "card": rf"{_IN}[0-9](?:[ -]?[0-9]){{12,18}}{_END}",
    "ssn": rf"{_IN}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
    "phone": rf"(?<![\p{{L}}\p{{N}}+])(?:\+[0-9]{{8,15}}|(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})[ .-]?[0-9]{{3,4}}[ .-][0-9]{{3,4}}){_END}",
    "iban": rf"{_IN}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,4}})?{_END}",
    "name": rf"{_IN}{_TITLE}\p{{Lu}}[\p{{L}}]+(?:[ -]\p{{Lu}}\p{{L}}+){{0,2}}",
    "han": rf"[{HAN_FAMILY}][\x{{4E00}}-\x{{9FFF}}]{{1,2}}{_HAN_TITLE}",
}
ANY = "|".join(PATTERNS.values())
#: A text without these has no mention.
HINT = rf"[0-9@]|{_TITLE}|{_HAN_TITLE}"
#: Attempts after which letters, and those after which digits and network addresses, grow.
WIDEN, LENGTHEN = 4, 12


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _parts() -> Column:
    """The parts of mention ``m`` of kind ``kind``: (type, canon, form); a type of null is kept as it is."""
    part = lambda kind, canon, form: f"named_struct('type', {kind}, 'canon', {canon}, 'form', {form})"
    kept = lambda form: part("cast(null AS string)", "cast(null AS string)", form)
    name = f"regexp_extract(m, {_sql('^' + _TITLE)}, 0)"
    gender = "CASE " + " ".join(f"WHEN {name} rlike {_sql('^(?:' + '|'.join(titles) + ')[. ]')} THEN '{kind}'" for titles, kind in ((MALE, "given_m"), (FEMALE, "given_f"))) + " ELSE 'given_u' END"
    han = f"regexp_extract(m, {_sql(_HAN_TITLE + '$')}, 0)"
    han_given = f"substr(m, 2, length(m) - 1 - length({han}))"
    left, right = "filter(split(substring_index(lower(m), '::', 1), ':'), x -> x <> '')", "filter(split(CASE WHEN m like '%::%' THEN substring_index(lower(m), '::', -1) ELSE '' END, ':'), x -> x <> '')"
    groups = f"transform(concat({left}, array_repeat('0', 8 - size({left}) - size({right})), {right}), x -> lpad(x, 4, '0'))"
    tokens = f"regexp_extract_all(substr(m, length({name}) + 1), '[ -]|[^ -]+', 0)"
    token = part(f"CASE WHEN t rlike '^[ -]' THEN null WHEN i = size({tokens}) - 1 THEN 'family' ELSE {gender} END", "lower(t)", "t")
    prefix = r"regexp_extract(m, '^(\\+[0-9]{1,3}[ .-]?(?=[(0-9].*[ .-]))?', 0)"
    number = lambda form: f"lower(regexp_replace({form}, '[^\\\\p{{L}}\\\\p{{N}}]', ''))"
    domain = "substring_index(m, '@', -1)"
    cases = {
        "email": f"array({part(_sql('email'), 'lower(m)', _at('m', 0))}, {kept(_sql('@'))}, {part(_sql('domain'), f'lower({domain})', _stem(domain))}, {kept(f'concat({_sql(".")}, substring_index(m, {_sql(".")}, -1))')})",
        "name": f"concat(array({kept(name)}), transform({tokens}, (t, i) -> {token}))",
        "phone": f"array({kept(prefix)}, {part(_sql('phone'), number(f'substr(m, length({prefix}) + 1)'), f'substr(m, length({prefix}) + 1)')})",
        "ip": f"array({part(_sql('ip'), 'm', 'm')})",
        "ip6": f"array({part(_sql('ip6'), f'array_join({groups}, {_sql(":")})', 'm')})",
        "key": f"array({kept('substr(m, 1, 4)')}, {part(_sql('key'), 'm', 'substr(m, 5)')})",
        "han": f"array({part(_sql('family'), 'substr(m, 1, 1)', 'substr(m, 1, 1)')}, {part(f'CASE WHEN {han} rlike {_sql("|".join(HAN_MALE))} THEN {_sql("given_m")} ELSE {_sql("given_f")} END', han_given, han_given)}, {kept(han)})",
    }
    cases |= {kind: f"array({part(_sql(kind), number('m'), 'm')})" for kind in ("card", "ssn", "iban", "secret")}
    return F.expr("CASE kind " + " ".join(f"WHEN '{kind}' THEN {sql}" for kind, sql in cases.items()) + " END")


def _at(text: str, k: int) -> str:
    return f"substring_index({text}, '@', {-1 if k else 1})"


def _stem(domain: str) -> str:
    """A domain without its last label and the point before it."""
    return f"regexp_replace({domain}, '\\\\.[^.]*$', '')"


def _letter(c: str, v: str, i: str) -> str:
    """A keyed character of the class of ``c``: ``v`` decides, ``i`` is its place from 1."""
    pick = lambda letters: f"substr('{letters}', 1 + {v} % {len(letters)}, 1)"
    named = "type IN ('given_m', 'given_f', 'given_u', 'family')"
    cases = [f"WHEN {c} rlike '[0-9]' THEN cast({v} % 10 AS string)", f"WHEN type = 'secret' THEN {pick('abcdef')}"]
    for script, pattern in CLASSES.items():
        vowels, consonants = SCRIPTS[script]
        own = vowels[:6] if script == "han" else vowels
        last = f"WHEN type = 'given_f' AND {i} = length(base) THEN '{own[0]}' WHEN type = 'given_m' AND {i} = length(base) THEN {pick(consonants[-4:])}"
        cases.append(f"WHEN {c} rlike '{pattern.replace(chr(92), chr(92) * 2)}' THEN CASE {last} WHEN {named} AND {i} % 2 = 0 THEN {pick(own)} WHEN {named} THEN {pick(consonants)} ELSE {pick(vowels + consonants)} END")
    return "CASE " + " ".join(cases) + f" ELSE {c} END"


def _luhn(digits: str) -> str:
    """The check sum of a string of digits."""
    d = f"cast(substr({digits}, length({digits}) - i, 1) AS int)"
    return f"aggregate(transform(sequence(0, length({digits}) - 1), i -> CASE WHEN i % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END), 0, (a, x) -> a + x) % 10"


def _surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Adds ``sur`` to (type, canon, base, attempt)."""
    seed = f"concat_ws('|', {_sql(key)}, type, canon, attempt)"
    v = lambda i: f"cast(conv(substr(stream, 2 * {i} - 1, 2), 16, 10) AS int)"
    extra = f"greatest(0, attempt - CASE WHEN type IN ('card', 'ssn', 'phone', 'iban') THEN {LENGTHEN} ELSE {WIDEN} END)"
    out = entities.withColumn("grown", F.expr(f"CASE WHEN type IN ('ip', 'ip6') THEN base ELSE concat(base, repeat(substr(base, -1), {extra})) END"))
    out = out.withColumn("stream", F.expr(f"array_join(transform(sequence(0, cast(ceil(length(grown) / 64) AS int)), b -> sha2(concat({seed}, '#', b), 512)), '')"))
    letters = f"array_join(transform(sequence(1, length(grown)), i -> {_letter('substr(grown, i, 1)', v('i'), 'i')}), '')"
    octet = "CASE WHEN attempt > {w} THEN cast(1 + {v} % 254 AS string) WHEN length(o) = 3 THEN cast(100 + {v} % 155 AS string) WHEN length(o) = 2 THEN cast(10 + {v} % 90 AS string) ELSE cast(1 + {v} % 9 AS string) END".format(w=WIDEN, v=v("(k + 1)"))
    six = "concat('2001:0db8:', array_join(transform(sequence(1, 6), k -> substr(stream, 4 * k, 4)), ':'))"
    out = out.withColumn("drawn", F.expr(f"CASE WHEN grown = '' THEN '' WHEN type = 'ip6' OR type = 'ip' AND attempt > {LENGTHEN} THEN {six} WHEN type = 'ip' THEN array_join(transform(split(base, '[.]'), (o, k) -> {octet}), '.') ELSE {letters} END"))
    body = "concat(substr(base, 1, 1), substr(drawn, 2, length(drawn) - 2))"
    card = f"CASE WHEN {_luhn('base')} = 0 THEN concat({body}, cast((10 - {_luhn(f'concat({body}, {_sql("0")})')}) % 10 AS string)) ELSE concat({body}, substr(drawn, -1)) END"
    out = out.withColumn("sur", F.expr(f"CASE WHEN type = 'card' THEN {card} WHEN type = 'iban' THEN concat(substr(base, 1, 2), substr(drawn, 3)) ELSE drawn END"))
    return out.select("type", "canon", "base", "attempt", "sur")


def surrogate_table(entities: DataFrame, key: str, work: Workspace) -> DataFrame:
    """(type, canon, sur), distinct within a type and none a real identity, for distinct (type, canon, base)."""
    state, k = work.save(_surrogates(entities.withColumn("attempt", F.lit(0)), key), "surrogates-0"), 0
    while True:  # surrogates grow, so ever fewer collide
        k += 1
        real = state.select("type", F.col("base").alias("sur")).distinct().withColumn("taken", F.lit(True))
        keep = state.groupBy("type", "sur").agg(F.min("canon").alias("keeper"))
        marked = state.join(keep, ["type", "sur"]).join(real, ["type", "sur"], "left")
        again = work.save(marked.filter("canon <> keeper OR taken").select("type", "canon", "base", (F.col("attempt") + 1).alias("attempt")), f"again-{k}")
        if again.isEmpty():
            return state.select("type", "canon", "sur")
        state = work.save(state.join(again, ["type", "canon"], "left_anti").unionByName(_surrogates(again, key)), f"surrogates-{k}")
        work.drop(f"surrogates-{k - 1}")


def _rendered() -> Column:
    """Surrogate ``sur`` in the form of ``form``: its punctuation and case; characters beyond it follow at the end."""
    alnum = "'[^\\\\p{L}\\\\p{N}]'"
    place = f"length(regexp_replace(substr(form, 1, i), {alnum}, ''))"
    char = f"CASE WHEN substr(form, i, 1) rlike {alnum} THEN substr(form, i, 1) WHEN substr(form, i, 1) <> lower(substr(form, i, 1)) THEN upper(substr(sur, {place}, 1)) ELSE substr(sur, {place}, 1) END"
    body = f"array_join(transform(sequence(1, length(form)), i -> {char}), '')"
    return F.expr(f"CASE WHEN sur IS NULL OR form = '' THEN form WHEN type IN ('ip', 'ip6') THEN sur ELSE concat({body}, substr(sur, length(regexp_replace(form, {alnum}, '')) + 1)) END")


def replace_pii(documents: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents with surrogates in their text; ``count_col`` adds the number of mentions replaced."""
    work = Workspace(documents.sparkSession, "pii")
    docs = documents.select(F.col(f"`{text_col}`").cast("string").alias("text")).filter(F.col("text").rlike(HINT))
    found = docs.select(F.xxhash64("text").alias("h"), "text", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("found")).filter("size(found) > 0")
    found = found.select("h", F.sha2("text", 256).alias("digest"), "found").groupBy("h", "digest").agg(F.first("found").alias("found"))
    mentions = work.save(found.select("h", "digest", F.posexplode("found").alias("pos", "m")), "mentions")
    kind = "CASE " + " ".join(f"WHEN m rlike {_sql('^(?:' + p + ')$')} THEN '{k}'" for k, p in PATTERNS.items()) + " END"
    forms = work.save(mentions.select("m").distinct().withColumn("kind", F.expr(kind)).select("m", F.posexplode(_parts()).alias("part", "p")).select("m", "part", "p.*"), "forms")
    told = forms.filter("type IN ('given_m', 'given_f')").groupBy("canon").agg(F.min("type").alias("told"))
    forms = work.save(forms.join(told, "canon", "left").withColumn("type", F.expr("CASE WHEN type = 'given_u' THEN coalesce(told, type) ELSE type END")).drop("told"), "gendered")
    base = "CASE WHEN type IN ('ip', 'ip6') THEN canon WHEN type = 'key' THEN form WHEN type IN ('email', 'domain') THEN lower(regexp_replace(form, '[^\\\\p{L}\\\\p{N}]', '')) ELSE canon END"
    entities = forms.filter("type IS NOT NULL").select("type", "canon", F.expr(base).alias("base")).groupBy("type", "canon").agg(F.min("base").alias("base"))
    table = surrogate_table(work.save(entities, "entities"), key, work)
    drawn = forms.join(table, ["type", "canon"], "left").select("m", "part", _rendered().alias("r"))
    whole = work.save(drawn.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("part", "r"))).alias("rs")).select("m", F.expr("array_join(transform(rs, x -> x.r), '')").alias("r")), "whole")
    lists = mentions.join(whole, "m").groupBy("h", "digest").agg(F.array_sort(F.collect_list(F.struct("pos", "r"))).alias("rs"))
    lists = work.save(lists.select("h", "digest", F.expr("transform(rs, x -> x.r)").alias("rs")), "lists")

    # helper columns get names that no column of the documents has
    clear = lambda name: name if name not in documents.columns else clear(f"_{name}")
    h, digest, rs = clear("_h"), clear("_digest"), clear("_rs")
    renamed = lists.select(F.col("h").alias(h), F.col("digest").alias(digest), F.col("rs").alias(rs))
    keys, text = renamed.select(h).distinct(), F.col(f"`{text_col}`").cast("string")
    small = F.broadcast(keys) if lists.count() <= 500_000 else keys
    rows = documents.withColumn(h, F.xxhash64(text))
    rebuilt = F.array_join(F.zip_with(F.split(text, ANY, -1), F.col(rs), lambda gap, mention: F.concat(gap, F.coalesce(mention, F.lit("")))), "")
    # equal hashes choose the rows that need the join; the digest decides
    touched = rows.join(small, h, "left_semi").withColumn(digest, F.sha2(text, 256)).join(renamed, [h, digest], "left")
    others = rows.join(small, h, "left_anti")
    kept = [c for c in documents.columns if c != count_col]
    touched = touched.select(*(F.when(F.col(rs).isNull(), text).otherwise(rebuilt).alias(c) if c == text_col else F.col(f"`{c}`") for c in kept), *([F.greatest(F.size(rs), F.lit(0)).cast("long").alias(count_col)] if count_col else []))
    return touched.unionByName(others.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept), *([F.lit(0).cast("long").alias(count_col)] if count_col else [])))
