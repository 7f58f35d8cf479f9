"""Surrogates for personal data, with DataFrame functions only.

Entities are e-mail addresses, phone numbers, card numbers, IP addresses, social
security numbers, bank accounts and names after a form of address. Each distinct
value of a kind receives one surrogate, the same in every document, made from
sha256(key, attempt, value):

* digits become digits and letters become letters of the same case, script and
  place, so that separators, lengths and formats stay; card numbers keep their
  first digit and pass the Luhn check, IP parts stay below 256, mail domains
  become subdomains of example.org, one for each;
* names are replaced token by token, given names by given names of the gender the
  form of address shows, so "Mrs Anna Berg" and "Mrs Berg" stay one person; the
  syllables come from the script of the name.

A candidate is refused if it equals a real value of the table or another value's
candidate; the refused values try again with the next attempt. So different
values of a kind never share a surrogate; names and addresses grow after a few attempts, so
that there is always room. `key` is a secret of the caller.

Null and empty texts have no entities. A row is a document; null ids and repeated rows
are kept, further columns are ignored, an empty table gives no rows. Patterns read a text
of any length a bounded number of times.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch.llm.common import let
from tickwatch.session import stage

# What is detected, in order of preference where several match at one place. Each pattern reads a text
# a bounded number of times: an address starts where its run of characters does (or where the last entity ended) and
# gives nothing back, a domain has 127 labels at most, and looks ahead pass separators only.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.*+\d)",
    "card": r"(?<!\d)\d{4}(?:[ -]?\d{4}){3}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d.])(?:\+\d{1,3}[ .-]?)?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}(?![.-]*+\d)|\+\d{9,14}(?!\d)",
    "name": r"\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Señor|Señora|Monsieur|Madame|Господин|Госпожа)\.?"
            r" \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
ADDRESS = r"^(\p{L}+\.?) "
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа")
# Syllables of made-up names by script and place in the name.
SYLLABLES = {
    "latin": ("ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to".split(),
              {"f": "la na ra sa ta via lia nia".split(), "m": "ro no do mar ton ric las bert".split(),
               "s": "berg dale ford holm lund mont stad wick".split()}),
    "cyrillic": ("ба бе бо да де до га ка ке ко ла ле ло ма ме мо на не но па ра ре ро са се со та те то ви ли".split(),
                 {"f": "ла на ра са та вия лия ния".split(), "m": "ро но до мир тон рик лас берт".split(),
                  "s": "берг даль форд хольм лунд монт стад вик".split()}),
    "greek": ("βα βε βο γα γε γο δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το φα".split(),
              {"f": "λα να ρα σα τα βια λια νια".split(), "m": "ρος νος δος μος τας ριος λης νης".split(),
               "s": "ιδης ακης πουλος ογλου εας ατος ινος αλης".split()}),
}
# From this attempt on names and mail boxes grow by a syllable or a letter per attempt, so that room is never short.
GROWS_FROM = 2
MAX_ROUNDS = 40
_ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())


def found(text: Column) -> Column:
    """The entities of a text in order."""
    return F.regexp_extract_all(text, F.lit(_ALL), F.lit(0))


def kind_of(value: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(F.regexp_replace(value, f"^(?:{pattern})$", "") == "", F.lit(kind)).otherwise(out)
    return out


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256)


def _number(digest: Column, i: Column | int) -> Column:
    """The i-th of 32 numbers below 256 of a digest in hex digits."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(32)) * 2 + 1
    return F.conv(digest.substr(at, F.lit(2)), 16, 10).cast("int")


def _pick(choices: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(n, F.lit(len(choices))) + 1).cast("int"))


def _same_shape(value: Column, key: str, attempt: Column) -> Column:
    """Digits and ASCII letters replaced in place; long values take further digests."""
    blocks = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 32).cast("int")),
                                      lambda b: _digest(key, attempt, value, b)), "")

    def of(digest: Column) -> Column:
        def one(ch: Column, i: Column) -> Column:
            n = F.conv(digest.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int")
            return (F.when(ch.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
                    .when(ch.rlike("[a-z]"), F.char(F.pmod(n, F.lit(26)) + 97))
                    .when(ch.rlike("[A-Z]"), F.char(F.pmod(n, F.lit(26)) + 65)).otherwise(ch))

        return F.array_join(F.transform(F.split(value, ""), one), "")

    return let(blocks, of)


def _luhn(card: Column) -> Column:
    """The last digit replaced so that the sum of Luhn is a multiple of ten."""
    digits = F.reverse(F.split(F.regexp_replace(card, r"\D", ""), ""))

    def weigh(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i == 0, F.lit(0)).when(i % 2 == 1, F.when(n > 4, n * 2 - 9).otherwise(n * 2)).otherwise(n)

    total = F.aggregate(F.transform(digits, weigh), F.lit(0), lambda a, n: a + n)
    return F.concat(card.substr(F.lit(1), F.length(card) - 1),
                    F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def _growth(attempt: Column) -> Column:
    """One number for each syllable or letter that an attempt adds."""
    more = attempt - GROWS_FROM + 1
    return F.when(more > 0, F.sequence(F.lit(1), F.greatest(more, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def _name(token: Column, kind: str, key: str, attempt: Column) -> Column:
    def of(script: str) -> Column:
        middle, ends = SYLLABLES[script]
        parts = let(_digest(key, attempt, F.lit(kind), F.lower(token)), lambda d: F.concat(
            *[_pick(middle, _number(d, 2 * i) * 256 + _number(d, 2 * i + 1)) for i in range(3)],
            F.array_join(F.transform(_growth(attempt), lambda i: _pick(middle, _number(d, i + 10))), ""),
            _pick(ends[kind], _number(d, 9))))
        return F.when(token == F.upper(token), F.upper(parts)).otherwise(F.initcap(parts))

    return (F.when(token.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(token.rlike(r"\p{IsGreek}"), of("greek"))
            .otherwise(of("latin")))


def candidate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a value (for names: of one token) at an attempt."""
    def ip(shape: Column) -> Column:
        parts = F.transform(F.split(value, r"\."), lambda p, i: F.pmod(
            _number(_digest(key, attempt, value), i), F.lit(254)) + 1)
        return F.array_join(parts.cast("array<string>"), ".")

    shape = _same_shape(value, key, attempt)
    card = _luhn(F.concat(value.substr(1, 1), shape.substr(F.lit(2), F.length(value))))
    more = F.array_join(F.transform(_growth(attempt), lambda i: F.char(_number(_digest(key, attempt, value), i) % 26 + 97)), "")
    email = F.concat(_same_shape(F.substring_index(value, "@", 1), key, attempt), more)
    domain = F.concat(F.lit("h"), _digest(key, attempt, F.lit("domain"), value).substr(1, 6), more, F.lit(".example.org"))
    iban = F.concat(value.substr(1, 2), shape.substr(F.lit(3), F.length(value)))
    # A number keeps its country.
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .-])", 0)
    phone = F.concat(country, shape.substr(F.length(country) + 1, F.length(value)))
    return (F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "phone", phone).when(kind == "ip", ip(shape)).when(kind == "card", card)
            .when(kind == "iban", iban).when(kind == "name f", _name(value, "f", key, attempt))
            .when(kind == "name m", _name(value, "m", key, attempt)).when(kind == "name s", _name(value, "s", key, attempt))
            .otherwise(shape))


def parts_of(entity: Column) -> Column:
    """The values of an entity that get a surrogate each: itself, the tokens of a name with their roles, box and domain of an address."""
    def of(e: Column) -> Column:
        title = F.regexp_replace(F.regexp_extract(e, ADDRESS, 1), r"\.$", "")
        tokens = F.split(F.regexp_replace(e, ADDRESS, ""), " ")
        gender = F.when(title.isin(*FEMALE), F.lit("name f")).otherwise(F.lit("name m"))
        named = F.transform(tokens, lambda t, i: F.struct(
            F.when(i == F.size(tokens) - 1, F.lit("name s")).otherwise(gender).alias("kind"), t.alias("value")))
        mail = F.array(F.struct(F.lit("email").alias("kind"), F.lower(e).alias("value")),
                       F.struct(F.lit("domain").alias("kind"), F.lower(F.substring_index(e, "@", -1)).alias("value")))
        return let(kind_of(e), lambda k: F.when(k == "name", named).when(k == "email", mail).otherwise(
            F.array(F.struct(k.alias("kind"), e.alias("value")))))

    return let(entity, of)


def assign(values: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate for the distinct (kind, value); no two values of a kind share a surrogate."""
    values = stage(values.select("kind", "value").distinct(), "entities")
    open_, taken, attempt = values, None, 0
    while True:
        made = open_.withColumn("surrogate", candidate(F.col("kind"), F.col("value"), key, F.lit(attempt)))
        real = values.select("kind", F.col("value").alias("surrogate"))
        made = made.join(real, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            made = made.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        # Of values with the same candidate the smallest keeps it.
        won = made.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate")
        won = stage(won, "surrogates")
        taken = won if taken is None else taken.unionByName(won)
        open_ = stage(open_.join(won, ["kind", "value"], "left_anti"), "entities")
        attempt += 1
        if open_.isEmpty():
            return taken
        if attempt >= MAX_ROUNDS:
            raise ValueError(f"no free surrogate for some values after {attempt} attempts")


def surrogate_texts(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_entities, kinds, text for each row that has an entity; other rows have nothing to replace."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = rows.withColumn("entities", found(F.col("text"))).filter(F.size("entities") > 0)
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "with-entities")
    parts = (rows.select("row", F.posexplode("entities").alias("at", "entity"))
             .select("row", "at", F.posexplode(parts_of(F.col("entity"))).alias("n", "part"))
             .select("row", "at", "n", "part.kind", "part.value"))
    named = assign(parts, key)
    whole = (parts.join(stage(named, "surrogates"), ["kind", "value"]).groupBy("row", "at").agg(
        F.array_sort(F.collect_list(F.struct("n", "kind", "surrogate"))).alias("tokens"))
        .withColumn("kind", F.split_part(F.col("tokens")[0]["kind"], F.lit(" "), F.lit(1)))
        .withColumn("made", F.transform("tokens", lambda t: t["surrogate"]))
        .select("row", F.struct("at", "kind", F.when(F.col("kind") == "email", F.array_join("made", "@")).otherwise(
            F.array_join("made", " ")).alias("surrogate")).alias("new")))
    # As long as the document's own entities.
    new = whole.groupBy("row").agg(F.array_sort(F.collect_list("new")).alias("new"))

    def value(n: Column, i: Column) -> Column:
        return F.when(F.get(n, i)["kind"] == "name", F.concat_ws(
            " ", F.regexp_extract(F.get("entities", i), ADDRESS, 1), F.get(n, i)["surrogate"])).otherwise(
            F.get(n, i)["surrogate"])

    between = F.split("text", _ALL, -1)
    text = F.array_join(F.transform(between, lambda x, i: F.concat(
        x, F.coalesce(value(F.col("new"), i), F.lit("")))), "")
    return rows.join(new, "row").select(
        "doc_id", F.size("entities").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("new", lambda x: x["kind"]))), ",").alias("kinds"),
        text.alias("text"))
