"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Found in a text, in this order of preference at a place: e-mail addresses, IPv4
addresses, dates, social security numbers, telephone numbers, account and card
numbers. What its own rule validates is replaced by a keyed permutation of what
that rule admits (an alternating Feistel network of ROUNDS rounds over SHA-256), so equal values get equal
pseudonyms in every document, different values different ones, pseudonyms are valid
themselves, and the key's holder can invert them:

* e-mail: each digit of the local part stays a digit, each letter a letter of its
  case, the domain stays. The local part is cut into runs of 15 places.
* IPv4, octets 0 to 255: the 32 bits.
* date, a day of 1900 to 2099 as Y-M-D or D.M.Y with "-", "/" or "." between: the day's number.
* social security number, its area not 000, 666 or 900 on, its group not 00, its serial not 0000: its
  number among these, in the same places.
* telephone number of ten digits, with or without +1, area and exchange from 200 on: its
  number among these, in the same places.
* card or account number of 13 to 19 digits, in one run or in groups of four or of 4, 6 and 5, with a right check digit:
  all but the first and last are permuted and the last is worked out anew. A wrong check digit: no such number.

The key reaches the plan as the value of a scalar subquery over a relation of one row,
whose rows plans don't print: it is in no explain output, user interface or event
log. It is in the driver's memory, in the tasks sent to executors, and wherever the
caller keeps it; who can read those can invert pseudonyms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.shared import free_name

ROUNDS = 10
FIRST_DAY, DAYS = "1900-01-01", 73_049
#: DAYS is their product, so a day's number is a pair without a gap.
_DAY_SIDES = (4_297, 17)

# fixed values: the formats
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2(?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
NUMBER = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
ANY = "|".join((EMAIL, IPV4, DATE, SSN, PHONE, NUMBER))


def _sql(text: str) -> str:
    """A SQL literal of any text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _key_column(spark: SparkSession, key: str) -> Column:
    """The key as a scalar subquery over a local relation, made without a job and without a literal."""
    jvm = spark._jvm
    values = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 1)
    values[0] = key
    rows = jvm.java.util.ArrayList()
    rows.add(jvm.org.apache.spark.sql.RowFactory.create(values))
    schema = spark._jsparkSession.parseDataType(T.StructType([T.StructField("key", T.StringType(), False)]).json())
    return DataFrame(spark._jsparkSession.createDataFrame(rows, schema), spark).scalar()


def _feistel(key: str, kind: str, left: str, right: str, m: str, n: str, invert: bool = False) -> str:
    """SQL for the struct (l, r) that keyed rounds make of left, below m, and right, below n."""
    part = lambda x: f"cast(conv(substr(sha2(concat({key}, ':{kind}:', cast({m} as string), ':', cast({n} as string), ':', cast(i as string), ':', cast({x} as string)), 256), 1, 15), 16, 10) as bigint)"
    sign, order = ("-", f"sequence({ROUNDS}, 1, -1)") if invert else ("+", f"sequence(1, {ROUNDS})")
    odd = f"named_struct('l', pmod(s.l {sign} pmod({part('s.r')}, {m}), {m}), 'r', s.r)"
    even = f"named_struct('l', s.l, 'r', pmod(s.r {sign} pmod({part('s.l')}, {n}), {n}))"
    return f"aggregate({order}, named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> if(i % 2 = 1, {odd}, {even}))"


def _bind(value: str, name: str, body: str) -> str:
    """SQL for body with name standing for value, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(key: str, kind: str, digits: str, invert: bool) -> str:
    """SQL that permutes a string of up to 36 digits."""
    half, rest = "cast(length(d) div 2 as int)", "cast(length(d) - length(d) div 2 as int)"
    ten = lambda x: f"cast(rpad('1', {x} + 1, '0') as bigint)"
    mixed = _feistel(key, kind, f"if({half} = 0, 0, cast(left(d, {half}) as bigint))", f"cast(right(d, {rest}) as bigint)", ten(half), ten(rest), invert)
    return _bind(digits, "d", _bind(mixed, "t", f"concat(if({half} = 0, '', lpad(cast(t.l as string), {half}, '0')), lpad(cast(t.r as string), {rest}, '0'))"))


def _refill(shape: str, digits: str) -> str:
    """SQL that puts the characters of digits, in order, in place of the digits of shape."""
    step = "if(c rlike '[0-9]', named_struct('o', concat(a.o, substr(v, a.k, 1)), 'k', a.k + 1), named_struct('o', concat(a.o, c), 'k', a.k))"
    return _bind(digits, "v", f"aggregate(split({shape}, ''), named_struct('o', '', 'k', 1), (a, c) -> {step}, a -> a.o)")


def _luhn(digits: str) -> str:
    """SQL for the sum that a right check digit makes a multiple of ten."""
    worth = "cast(substr(d, length(d) - j, 1) as int)"
    return _bind(digits, "d", f"aggregate(sequence(0, length(d) - 1), 0L, (s, j) -> s + if(j % 2 = 1, ({worth} * 2) div 10 + ({worth} * 2) % 10, {worth}))")


def _letters(key: str, local: str, invert: bool) -> str:
    """SQL that permutes a local part, places keeping their kind: runs of 15 places are numbers of mixed radix."""
    radix = "case when c rlike '[0-9]' then 10L when c rlike '[A-Za-z]' then 26L else 1L end"
    worth = "case when c rlike '[0-9]' then ascii(c) - 48 when c rlike '[a-z]' then ascii(c) - 97 when c rlike '[A-Z]' then ascii(c) - 65 else 0 end"
    product = lambda x: f"aggregate(split({x}, ''), 1L, (a, c) -> a * {radix})"
    number = lambda x: f"aggregate(split({x}, ''), 0L, (a, c) -> a * {radix} + {worth})"
    letter = "case when c rlike '[0-9]' then cast(a.v % 10 as string) when c rlike '[a-z]' then chr(97 + a.v % 26) when c rlike '[A-Z]' then chr(65 + a.v % 26) else c end"
    write = lambda x, v: f"aggregate(reverse(split({x}, '')), named_struct('o', '', 'v', {v}), (a, c) -> named_struct('o', concat({letter}, a.o), 'v', a.v div {radix}), a -> a.o)"
    half = "cast(length(u) div 2 as int)"
    lo, hi = f"left(u, {half})", f"substr(u, {half} + 1)"
    zero = lambda x, y: f"if({half} = 0, {y}, {x})"
    mixed = _feistel(key, "email", zero(number(lo), "0L"), number(hi), "p.m", "p.n", invert)
    one = _bind(f"named_struct('m', {zero(product(lo), '1L')}, 'n', {product(hi)})", "p", _bind(mixed, "t", f"concat({zero(write(lo, 't.l'), repr(''))}, {write(hi, 't.r')})"))
    cut = "transform(sequence(0, cast((length(z) - 1) div 15 as int)), j -> substr(z, j * 15 + 1, 15))"
    return _bind(local, "z", f"array_join(transform({cut}, u -> {one}), '')")


def pseudonym(match: str, key: str, invert: bool = False) -> str:
    """SQL for the pseudonym of the SQL expression match, a string that ANY has found, or null if its rule rejects it; key is SQL too."""
    at = "x"
    plain = f"regexp_replace({at}, '[^0-9]', '')"
    is_ = lambda pattern: f"{at} rlike {_sql('^(?:' + pattern + ')$')}"
    octets = f"transform(split({at}, '[.]'), y -> cast(y as bigint))"
    ip = _bind(
        octets,
        "o",
        f"if(exists(o, y -> y > 255), null, "
        + _bind(_feistel(key, "ipv4", "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", invert), "t", "concat_ws('.', cast(t.l div 256 as string), cast(t.l % 256 as string), cast(t.r div 256 as string), cast(t.r % 256 as string))")
        + ")",
    )
    iso = f"{at} rlike '^[0-9]{{4}}'"
    mark = f"if({iso}, substr({at}, 5, 1), substr({at}, 3, 1))"
    day = f"datediff(try_to_timestamp({at}, if({iso}, concat('yyyy', {mark}, 'MM', {mark}, 'dd'), concat('dd', {mark}, 'MM', {mark}, 'yyyy'))), date'{FIRST_DAY}')"
    m, n = _DAY_SIDES
    back = f"date_format(date_add(date'{FIRST_DAY}', cast(t.l * {n} + t.r as int)), if({iso}, concat('yyyy', {mark}, 'MM', {mark}, 'dd'), concat('dd', {mark}, 'MM', {mark}, 'yyyy')))"
    date = _bind(day, "y", f"if(y is null or y < 0 or y >= {DAYS}, null, " + _bind(_feistel(key, "date", f"y div {n}", f"y % {n}", str(m), str(n), invert), "t", back) + ")")
    # an area without 000, 666 and 9xx, and a group: one side; a serial: the other
    area, group, serial = (f"cast(substr(e, {i}, {n}) as bigint)" for i, n in ((1, 3), (4, 2), (6, 4)))
    left = f"(if({area} > 666, {area} - 2, {area} - 1) * 99 + {group} - 1)"
    back = "concat(lpad(cast(if(t.l div 99 >= 665, t.l div 99 + 2, t.l div 99 + 1) as string), 3, '0'), lpad(cast(t.l % 99 + 1 as string), 2, '0'), lpad(cast(t.r + 1 as string), 4, '0'))"
    made = _bind(_feistel(key, "ssn", left, f"{serial} - 1", str(898 * 99), "9999", invert), "t", back)
    ssn = _bind(plain, "e", f"if({area} in (0, 666) or {area} >= 900 or {group} = 0 or {serial} = 0, null, {_refill(at, made)})")
    # area and exchange: one side; the line: the other
    area, exchange, line = (f"cast(substr(e, {i}, {n}) as bigint)" for i, n in ((1, 3), (4, 3), (7, 4)))
    made = _bind(_feistel(key, "phone", f"(({area} - 200) * 800 + {exchange} - 200)", line, "640000", "10000", invert), "t", "concat(cast(t.l div 800 + 200 as string), cast(t.l % 800 + 200 as string), lpad(cast(t.r as string), 4, '0'))")
    whole = f"if(length({plain}) = 11, concat(substr({at}, 1, 2), {_refill(f'substr({at}, 3)', made)}), {_refill(at, made)})"
    phone = _bind(f"right({plain}, 10)", "e", f"if({area} < 200 or {exchange} < 200, null, {whole})")
    middle = _digits(key, "card", "substr(e, 2, length(e) - 2)", invert)
    body = _bind(f"concat(left(e, 1), {middle})", "g", f"concat(g, cast(pmod(-({_luhn("concat(g, '0')")}), 10) as string))")
    number = _bind(plain, "e", f"case when {_luhn('e')} % 10 = 0 then {_refill(at, body)} end")
    email = f"concat({_letters(key, f'substring_index({at}, {_sql(chr(64))}, 1)', invert)}, substr({at}, instr({at}, '@')))"
    rules = [(EMAIL, email), (IPV4, ip), (DATE, date), (SSN, ssn), (PHONE, phone), (NUMBER, number)]
    return _bind(match, "x", "case " + " ".join(f"when {is_(p)} then {sql}" for p, sql in rules) + " end")


def pseudonymise(docs: DataFrame, key: str, invert: bool = False) -> DataFrame:
    """docs with text rewritten, and n_replaced int: how many valid values were found, each replaced by its pseudonym, which may by chance be itself. Null stays null, with 0; an empty text stays.

    Every whole text is read, and rows are taken one by one: repeated rows give repeated
    rows. A column of docs named n_replaced gives way to the new one; all others stay. With invert, the pseudonyms made
    with the key are turned back.
    """
    docs = docs.drop("n_replaced")
    columns = docs.columns
    found, new, secret = (free_name(n, docs) for n in ("_found", "_new", "_key"))
    has = F.expr("case when text rlike '[0-9@]' then regexp_extract_all(text, " + _sql(ANY) + ", 0) end")
    docs = docs.withColumns({found: has, secret: _key_column(docs.sparkSession, key)})
    docs = docs.withColumn(new, F.expr(f"transform({found}, f -> {pseudonym('f', secret, invert)})"))
    text = F.expr(f"case when size({found}) > 0 then array_join(zip_with(zip_with(split(text, {_sql(ANY)}, -1), {found}, (p, f) -> struct(p, f)), {new}, (x, n) -> concat(x.p, coalesce(n, x.f, ''))), '') else text end")
    count = F.expr(f"cast(coalesce(size(filter({new}, x -> x is not null)), 0) as int)")
    count = F.when(F.col(found).isNull(), F.lit(0)).otherwise(count)
    return docs.withColumn("n_replaced", count).withColumn("text", text).select(*columns, "n_replaced")
