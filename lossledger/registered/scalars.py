"""Scalar functions (H) over whole tables.

Texts to parse are made from the tables: a date or an amount is written out in one of
several forms and read back, so the SQL side knows the answer without parsing.
"""

from pyspark.sql import functions as F

from ..functions import dates, fixed_values, money
from ..functions import text as tx
from .base import query


def _key():
    return F.col("o_orderkey")


def _day():
    return F.col("o_orderdate")


def _price():
    return F.col("o_totalprice").cast("decimal(18,2)")


def _choose(key, forms):
    """The form whose number is ``key`` modulo the number of forms."""
    out = F.when(key % len(forms) == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        out = out.when(key % len(forms) == i, form)
    return out


@query("h1_date_parts", """
    SELECT event_id, strftime(ts, '%Y') AS y, strftime(ts, '%Y-%m') AS m, strftime(ts, '%Y') || '-Q' || quarter(ts) AS q,
           strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%m') AS n FROM events""")
def date_parts(v):
    parts = {"y": "year", "m": "month", "q": "quarter", "d": "day", "n": "month_num"}
    return v.events.select("event_id", *[dates.date_part(F.col("ts"), op).alias(a) for a, op in parts.items()])


@query("h2_tolerant_timestamps", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS ts FROM orders""")
def tolerant_timestamps(v):
    text = _choose(_key(), [
        F.date_format(_day(), "yyyy-MM-dd HH:mm:ss"),
        F.date_format(_day(), "dd.MM.yyyy HH:mm:ss"),
        F.date_format(_day(), "d.M.yyyy"),
        F.concat(F.lit(" "), F.date_format(_day(), "yyyy-MM-dd"), F.lit(" ")),
        F.date_format(_day(), "dd.MM.yyyy HH:mm"),
        F.lit("nan"),
        F.concat(F.lit("31.02."), F.date_format(_day(), "yyyy")),
    ])
    return v.orders.select("o_orderkey", dates.tolerant_timestamp(text).alias("ts"))


_MONTH_NAMES = ", ".join(f"'{m[1]}'" for m in fixed_values.MONTHS)
_GENITIVE = ", ".join(f"'{m[2]}'" for m in fixed_values.MONTHS)


def _period_sql() -> str:
    # One CASE per phrase form of the query below; years before 2000 are no years to the parser.
    start = """CASE f WHEN 0 THEN date_trunc('quarter', d) WHEN 1 THEN date_trunc('month', d)
        WHEN 2 THEN date_trunc('year', d) WHEN 3 THEN d WHEN 4 THEN CASE WHEN month(d) < 7 THEN date_trunc('year', d)
        ELSE date_trunc('year', d) + INTERVAL 6 MONTH END WHEN 5 THEN date_trunc('month', d)
        WHEN 6 THEN date_trunc('year', d) WHEN 7 THEN CASE WHEN year(d) < 2000 THEN last ELSE d END END"""
    end = """CASE f WHEN 0 THEN date_trunc('quarter', d) + INTERVAL 3 MONTH WHEN 1 THEN date_trunc('month', d) + INTERVAL 1 MONTH
        WHEN 2 THEN date_trunc('year', d) + INTERVAL 1 YEAR WHEN 3 THEN d + INTERVAL 1 DAY
        WHEN 4 THEN CASE WHEN month(d) < 7 THEN date_trunc('year', d) + INTERVAL 6 MONTH ELSE date_trunc('year', d) + INTERVAL 1 YEAR END
        WHEN 5 THEN date_trunc('month', d) + INTERVAL 10 DAY
        WHEN 6 THEN date_trunc('month', d) + INTERVAL 1 MONTH WHEN 7 THEN last + INTERVAL 1 DAY END"""
    kind = """CASE f WHEN 0 THEN 'quarter' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 4 THEN 'half'
        WHEN 6 THEN CASE WHEN month(d) = 1 THEN 'month' ELSE 'range' END ELSE 'range' END"""
    label = f"""CASE f WHEN 0 THEN 'Q' || quarter(d) || ' ' || year(d)
        WHEN 1 THEN [{_MONTH_NAMES}][month(d)] || ' ' || year(d)
        WHEN 2 THEN year(d) || ' год' WHEN 3 THEN strftime(d, '%d.%m.%Y')
        WHEN 4 THEN CASE WHEN month(d) < 7 THEN 'первое' ELSE 'второе' END || ' полугодие ' || year(d)
        WHEN 5 THEN 'первые 10 дня ' || [{_GENITIVE}][month(d)] || ' ' || year(d)
        WHEN 6 THEN CASE WHEN month(d) = 1 THEN 'январь' ELSE 'январь-' || [{_MONTH_NAMES}][month(d)] END || ' ' || year(d)
        WHEN 7 THEN CASE WHEN year(d) < 2000 THEN '' ELSE strftime(d, '%d.%m.%Y') || '-' END || strftime(last, '%d.%m.%Y') END"""
    return f"""
        SELECT o_orderkey, CASE WHEN ok THEN strftime({start}, '%Y-%m-%d') END AS period_start,
               CASE WHEN ok THEN strftime({end}, '%Y-%m-%d') END AS period_end,
               CASE WHEN ok THEN {kind} END AS kind, CASE WHEN ok THEN {label} END AS label
        FROM (SELECT o_orderkey, o_orderkey % 8 AS f, CAST(o_orderdate AS DATE) AS d,
                     CAST(o_orderdate + INTERVAL 9 DAY AS DATE) AS last,
                     year(CASE WHEN o_orderkey % 8 = 7 THEN o_orderdate + INTERVAL 9 DAY ELSE o_orderdate END) >= 2000 AS ok
              FROM orders)"""


@query("h3_period_phrases", _period_sql())
def period_phrases(v):
    names = F.element_at(F.array(*[F.lit(m[1]) for m in fixed_values.MONTHS]), F.month(_day()))
    genitive = F.element_at(F.array(*[F.lit(m[2]) for m in fixed_values.MONTHS]), F.month(_day()))
    year = F.date_format(_day(), "yyyy")
    half = F.when(F.month(_day()) < 7, F.lit("Первое")).otherwise(F.lit("второе"))
    last = F.date_add(F.to_date(_day()), 9)
    phrase = _choose(_key(), [
        F.concat(F.lit("отчёт за "), F.quarter(_day()).cast("string"), F.lit("-й квартал "), year),
        F.concat(F.lit("за "), F.initcap(names), F.lit(" "), year, F.lit(" года")),
        F.concat(F.lit("инциденты за "), year, F.lit(" год")),
        F.concat(F.lit("за "), F.date_format(_day(), "dd.MM.yyyy")),
        F.concat(half, F.lit(" полугодие "), year),
        F.concat(F.lit("за первые десять дней "), genitive, F.lit(" "), year),
        F.concat(F.lit("с января по "), names, F.lit(" "), year),
        F.concat(F.date_format(_day(), "yyyy-MM-dd"), F.lit(" .. "), F.date_format(last, "yyyy-MM-dd")),
    ])
    phrases = v.orders.select("o_orderkey", phrase.alias("phrase"))
    return dates.with_period(phrases, "phrase", "p").select(
        "o_orderkey", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"),
        F.col("p.kind").alias("kind"), F.col("p.label").alias("label"),
    )


@query("h4_money_text", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END::DOUBLE AS amount
    FROM orders""")
def money_text(v):
    spaced = F.translate(F.format_number(_price(), 2), ",", " ")
    text = _choose(_key(), [
        F.concat(spaced, F.lit(" ₽")),
        F.concat(F.translate(spaced, ".", ","), F.lit(" руб")),
        _price().cast("string"),
        F.lit("нет данных"),
    ])
    return v.orders.select("o_orderkey", money.money_number(text).alias("amount"))


@query("h5_amount_conditions", """
    SELECT o_orderkey, n, CASE (o_orderkey + n) % 3 WHEN 0 THEN '>' WHEN 1 THEN '<' ELSE '=' END AS op,
           CASE n WHEN 0 THEN t * 1000 WHEN 1 THEN (t + 0.5) * 1000000 ELSE t * 1000000000 END::DOUBLE AS value
    FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS t, unnest([0, 1, 2]) AS n FROM orders)""")
def amount_conditions(v):
    t = F.floor(F.col("o_totalprice") / 1000).cast("string")

    def word(n: int):
        return _choose(_key() + n, [F.lit("больше"), F.lit("меньше"), F.lit("=")])

    phrase = F.concat_ws(
        " ", F.lit("Сумма"), word(0), t, F.lit("тыс и"), word(1), F.concat(t, F.lit(",5")), F.lit("млн, а также"),
        word(2), t, F.lit("млрд"),
    )
    found = v.orders.select(
        "o_orderkey", F.posexplode_outer(money.amount_conditions(phrase)).alias("n", "c")
    )
    return found.filter(F.col("c").isNotNull()).select("o_orderkey", "n", "c.op", "c.value")


@query("h6_rare_unicode", r"""
    SELECT doc_id, length(regexp_replace(text || chr(8) || 'ᄨ' || '中' || 'я', '[\x{1128}-\x{FFFF}\x02\x08\x0b]', '', 'g')) AS n
    FROM documents""")
def rare_unicode(v):
    dirty = F.concat("text", F.char(F.lit(8)), F.lit("ᄨ中я"))
    return v.texts.select("doc_id", F.length(tx.strip_rare_unicode(dirty)).cast("bigint").alias("n"))


_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query("h8_normal_forms", rf"""
    SELECT doc_id, {_NORM} AS norm, regexp_replace(lower(text), '[^0-9a-zа-яё]+', '', 'g') AS tight,
           len(list_distinct(list_filter(string_split({_NORM}, ' '), lambda t: length(t) >= 2))) AS n_tokens
    FROM documents""")
def normal_forms(v):
    c = F.col("text")
    forms = v.texts.select("doc_id", tx.norm(c).alias("norm"), tx.tight(c).alias("tight"))
    return forms.withColumn("n_tokens", F.size(tx.words_of_normal(F.col("norm"))))


@query("h9_tokens", r"""
    SELECT token, COUNT(*) AS cnt, COUNT(DISTINCT doc_id) AS docs FROM (
        SELECT doc_id, unnest(regexp_extract_all(lower(text), '[а-яёa-z0-9]+')) AS token FROM documents) GROUP BY 1""")
def token_counts(v):
    # Counted per document first, so a word in every text does not travel once per use.
    per_doc = (
        tx.one_per_row(v.texts, tx.tokens(F.col("text")), "token", ["doc_id"])
        .groupBy("token", "doc_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_doc.groupBy("token").agg(F.sum("n").alias("cnt"), F.count(F.lit(1)).alias("docs"))


@query("h10_thousands", """
    SELECT o_orderkey, trim(replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', ' ')) AS text FROM orders""")
def thousands_text(v):
    return v.orders.select("o_orderkey", money.thousands(F.col("o_totalprice")).alias("text"))


@query("h10_compact_money", """
    SELECT o_orderkey, CASE WHEN a >= 1000000000 THEN regexp_replace(format('{:.1f}', a / 1000000000), '\\.0$', '') || ' млрд'
               WHEN a >= 1000000 THEN regexp_replace(format('{:.1f}', a / 1000000), '\\.0$', '') || ' млн'
               WHEN a >= 1000 THEN format('{:.0f}', a / 1000) || ' тыс'
               ELSE CAST(CAST(floor(a) AS BIGINT) AS VARCHAR) END AS text
    FROM (SELECT o_orderkey, o_totalprice * (o_orderkey % 100) * (CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 0.0001 END) AS a FROM orders)""")
def compact_money_text(v):
    factor = F.when(_key() % 2 == 0, F.lit(100.0)).otherwise(F.lit(0.0001))
    amount = F.col("o_totalprice") * (_key() % 100) * factor
    return v.orders.select("o_orderkey", money.compact_money(amount).alias("text"))


@query("h11_flag_and_default", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '1' ELSE '0' END AS off_balance,
           COALESCE(CASE WHEN o_orderpriority = '5-LOW' THEN CAST(o_totalprice AS DECIMAL(18,2)) END, 0)::DOUBLE AS penalty
    FROM orders""")
def flag_and_default(v):
    from ..operators.credit import off_balance_flag

    penalty = F.when(F.col("o_orderpriority") == "5-LOW", _price())
    return v.orders.select(
        "o_orderkey",
        off_balance_flag(F.col("o_orderstatus"), "P").alias("off_balance"),
        F.coalesce(penalty, F.lit(0).cast("decimal(18,2)")).alias("penalty"),
    )


@query("h12_loose_types", """
    SELECT incdnt_id, CAST(incdnt_sum AS DOUBLE) AS incdnt_sum, strftime(incdnt_entry_dt, '%Y-%m-%d %H:%M:%S') AS incdnt_entry_dt
    FROM incident_base""", ("incident_base",))
def loose_types(v):
    from ..operators.projection import for_export

    zoned = v.incident_base.withColumn("incdnt_entry_dt", F.col("incdnt_entry_dt").cast("timestamp"))
    return for_export(zoned.select("incdnt_id", "incdnt_sum", "incdnt_entry_dt"))


@query("h13_joined_parts", """
    SELECT doc_id, concat_ws(' ', t, s) AS joined,
           concat_ws(chr(10), 'Текст номер ' || doc_id || ': ' || t, 'Источник номер ' || doc_id || ': ' || s) AS numbered
    FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\s]') THEN text END AS t, CASE WHEN quality = 1 THEN source END AS s
          FROM documents LEFT JOIN labels USING (doc_id))""")
def joined_parts(v):
    df = v.documents.join(v.labels, "doc_id", "left")
    source = F.when(F.col("quality") == 1, F.col("source")).otherwise(F.lit("  "))
    return df.select(
        "doc_id",
        tx.join_parts(F.col("text"), source).alias("joined"),
        tx.numbered_parts(F.col("doc_id"), [("Текст номер", F.col("text")), ("Источник номер", source)]).alias("numbered"),
    )


@query("h14_ellipsis", """
    SELECT doc_id, CASE WHEN length(text) > 1500 THEN left(text, 1500) || '...' ELSE text END AS long,
           CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS short FROM documents""")
def ellipsis(v):
    c = F.col("text")
    return v.documents.select("doc_id", tx.ellipsis(c, 1500).alias("long"), tx.ellipsis(c, 80).alias("short"))


@query("h15_logistic", """
    SELECT event_id, ROUND(1 / (1 + exp(-(value / 100.0 - 1.0))), 6) AS score FROM events""")
def logistic(v):
    return v.events.select(
        "event_id", F.round(tx.logistic(F.col("value") / 100.0 - 1.0), 6).alias("score")
    )


_N = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"


@query("h16_repeated_neighbours", rf"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    marked AS (SELECT *, {_N.format('line')} AS n, LAG({_N.format('line')}) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM lines),
    kept AS (SELECT doc_id, i, line, n FROM marked WHERE n = '' OR before IS NULL OR n <> before),
    parts AS (SELECT doc_id, i, line, n, string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM kept),
    sentences AS (SELECT doc_id, i, n, line, unnest(s) AS sentence, generate_subscripts(s, 1) AS j FROM parts),
    marked2 AS (SELECT *, {_N.format('sentence')} AS m, LAG({_N.format('sentence')}) OVER (PARTITION BY doc_id, i ORDER BY j) AS before FROM sentences),
    cleaned AS (SELECT doc_id, i, CASE WHEN n = '' THEN any_value(line)
                    ELSE string_agg(sentence, ' ' ORDER BY j) FILTER (WHERE m = '' OR before IS NULL OR m <> before) END AS line,
                    CASE WHEN n = '' THEN 0 ELSE COUNT(*) - COUNT(*) FILTER (WHERE m = '' OR before IS NULL OR m <> before) END AS dropped
                FROM marked2 GROUP BY doc_id, i, n)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS cleaned,
           ((SELECT COUNT(*) FROM lines l WHERE l.doc_id = cleaned.doc_id) - COUNT(*) + SUM(dropped))::BIGINT AS removed
    FROM cleaned GROUP BY doc_id""")
def repeated_neighbours(v):
    return tx.collapse_neighbours(v.texts.select("doc_id", "text"), "text", "cleaned").select(
        "doc_id", "cleaned", F.col("cleaned_removed").alias("removed")
    )


@query("h17_repeated_cycles", r"""
    WITH RECURSIVE lines AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i,
               len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
    keyed AS (SELECT *, lower(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS k FROM lines),
    compared AS (  -- does line i equal the one s lines below, and has one of the s lines from i on a word
        SELECT a.doc_id, a.i, a.n, s, a.k = b.k AS same FROM keyed a, range(1, 13) t(s), keyed b
        WHERE b.doc_id = a.doc_id AND b.i = a.i + s),
    runs AS (SELECT doc_id, i, s, COALESCE(MIN(i) FILTER (NOT same) OVER w, n - s + 1) - i AS run FROM compared
             WINDOW w AS (PARTITION BY doc_id, s ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    worded AS (SELECT doc_id, i, COALESCE(MIN(i) FILTER (k <> '') OVER (PARTITION BY doc_id ORDER BY i
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n + 1) AS next_word FROM keyed),
    steps AS (SELECT doc_id, i, MIN(s) AS s, arg_min(run // s, s) AS again FROM runs JOIN worded USING (doc_id, i)
              WHERE run >= s AND next_word < i + s GROUP BY 1, 2),
    walk AS (
        SELECT doc_id, 1::BIGINT AS pos, n FROM keyed WHERE i = 1
        UNION ALL
        SELECT w.doc_id, w.pos + COALESCE(s + again * s, 1), w.n FROM walk w LEFT JOIN steps ON steps.doc_id = w.doc_id AND i = w.pos
        WHERE w.pos + COALESCE(s + again * s, 1) <= w.n),
    kept AS (SELECT w.doc_id, unnest(range(pos, pos + COALESCE(s, 1))) AS i FROM walk w LEFT JOIN steps ON steps.doc_id = w.doc_id AND i = pos)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS cleaned FROM kept JOIN lines USING (doc_id, i) GROUP BY 1
    UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""")
def repeated_cycles(v):
    return v.texts.select("doc_id", tx.collapse_cycles(F.col("text")).alias("cleaned"))


@query("h18_repeated_sections", r"""
    WITH headed AS (
        SELECT doc_id, regexp_replace(regexp_replace(text, '(^|\n)([^\n]{0,40}\.)\n', '\1# \2' || chr(10), 'g'), '(^|\n)Of ', '\11. Of ', 'g') AS text
        FROM documents),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM headed),
    titled AS (SELECT *, regexp_matches(trim(line), '^(#+\s*|\d+\.\s*).') AND
                   regexp_extract(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^(?:#+\s*|\d+\.\s*)(.+)$', 1) <> '' AS is_header,
               regexp_extract(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^(?:#+\s*|\d+\.\s*)(.+)$', 1) AS title FROM lines),
    keyed AS (SELECT *, SUM(is_header::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section,
                     trim(regexp_replace(lower(trim(regexp_replace(title, '[^\pL\pN_\s]', '', 'g'))), '^\d+\s*', '')) AS k FROM titled),
    sections AS (SELECT doc_id, section, MAX(CASE WHEN is_header THEN k END) AS k FROM keyed GROUP BY 1, 2),
    kept AS (SELECT doc_id, section FROM sections
             QUALIFY k IS NULL OR k = '' OR ROW_NUMBER() OVER (PARTITION BY doc_id, k ORDER BY section) = 1)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS cleaned FROM keyed JOIN kept USING (doc_id, section) GROUP BY 1""")
def repeated_sections(v):
    # The texts carry no headers of their own: short lines and lines that open with "Of" get one.
    short = F.regexp_replace("text", r"(^|\n)([^\n]{0,40}\.)\n", "$1# $2\n")
    headed = F.regexp_replace(short, r"(^|\n)Of ", "$11. Of ")
    return tx.drop_repeated_sections(
        v.texts.select("doc_id", headed.alias("text")), "text", "cleaned"
    ).select("doc_id", "cleaned")


@query("h19_codes_and_quotes", """
    SELECT o_orderkey, kind, value FROM (
        SELECT o_orderkey, 'code' AS kind, 'EVE-' || o_orderkey AS value FROM orders
        UNION ALL SELECT o_orderkey, 'code', 'DRP-' || o_custkey FROM orders
        UNION ALL SELECT o_orderkey, 'code', 'П' || (100 + o_orderkey) FROM orders
        UNION ALL SELECT o_orderkey, 'quoted', o_orderpriority FROM orders)""")
def codes_and_quotes(v):
    text = F.concat(
        F.lit("Инцидент EVE-"), _key(), F.lit(" по профилю DRP-"), F.col("o_custkey"), F.lit(", процесс П"),
        _key() + 100, F.lit(" с типом «"), F.col("o_orderpriority"), F.lit("» и XП12"),
    )
    found = v.orders.select("o_orderkey", text.alias("text"))
    codes = tx.one_per_row(found, tx.codes_in(F.col("text")), "value", ["o_orderkey"])
    quotes = tx.one_per_row(found, tx.quoted_in(F.col("text")), "value", ["o_orderkey"])
    return codes.withColumn("kind", F.lit("code")).unionByName(quotes.withColumn("kind", F.lit("quoted")))


@query("h20_ending_variants", """
    SELECT o_orderkey, unnest(CASE o_orderkey % 3
        WHEN 0 THEN ['Северо-Горному', 'Северо-Горный', 'Северо-Горном', 'Северо-Горномо', 'Северо-Горноме',
                     'Северо-Горнома', 'Северо-Горномие', 'Северо-Горномия']
        WHEN 1 THEN ['обращениям', 'обращен', 'обращено', 'обращене', 'обращена', 'обращение', 'обращения']
        ELSE ['банк'] END) AS variant FROM orders""")
def ending_variants(v):
    word = _choose(_key(), [F.lit("Северо-Горному"), F.lit("обращениям"), F.lit("банк")])
    return tx.one_per_row(v.orders, tx.ending_variants(word), "variant", ["o_orderkey"])


# Part names in Cyrillic letters, each with an ending by its key.
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz ", "абцдефгхийклмнопкрстуввхыз-"
_ENDINGS = ("ому", "ого", "ая", "ые", "иями", "ов", "а", "")


def _stem_before(endings) -> str:
    return f"'(?i)^(.{{3,}}?)(?:{'|'.join(endings)})$'"


_ADJECTIVE, _NOUN = _stem_before(fixed_values.ADJECTIVE_ENDINGS), _stem_before(fixed_values.NOUN_ENDINGS)


@query("h20_ending_variants_of_names", f"""
    WITH words AS (
        SELECT p_partkey, translate(lower(p_name), '{_LATIN}', '{_CYRILLIC}') ||
               ({list(_ENDINGS)})[CAST(p_partkey % {len(_ENDINGS)} AS BIGINT) + 1] AS word FROM part),
    parts AS (
        SELECT p_partkey, word, list_transform(string_split(word, '-'), lambda p: CASE WHEN regexp_matches(p, {_ADJECTIVE})
            THEN regexp_extract(p, {_ADJECTIVE}, 1) || CASE WHEN regexp_matches(lower(regexp_extract(p, {_ADJECTIVE}, 1)),
                 '[{fixed_values.SOFT_STEM_LETTERS}]$') THEN 'ий' ELSE 'ый' END ELSE p END) AS nominative FROM words),
    variants AS (
        SELECT p_partkey, word, array_to_string(nominative, '-') AS variant FROM parts
        UNION ALL SELECT p_partkey, word, word FROM words
        UNION ALL SELECT p_partkey, word, regexp_extract(word, {_NOUN}, 1) || unnest({list(fixed_values.NOUN_SUFFIXES)})
                  FROM words WHERE regexp_matches(word, {_NOUN}))
    SELECT DISTINCT p_partkey, word, variant FROM variants""")
def ending_variants_of_names(v):
    endings = F.array(*[F.lit(e) for e in _ENDINGS])
    word = F.concat(
        F.translate(F.lower("p_name"), _LATIN, _CYRILLIC),
        F.get(endings, (F.col("p_partkey") % len(_ENDINGS)).cast("int")),
    )
    words = v.part.select("p_partkey", word.alias("word"))
    return tx.one_per_row(words, tx.ending_variants(F.col("word")), "variant", ["p_partkey", "word"])
