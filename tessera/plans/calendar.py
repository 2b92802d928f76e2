"""Calendar rows of four cells (arrays of lines): each line is read by what it is, not by where it stands."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.html import read_tables
from ..functions.text import fold
from ..sources.shared import kept

# Months in order, weekdays from Sunday on, colours, notes of discipline, the class, the readings' separator.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
WEEKDAYS = ("Domingo", "Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado")
WEEKDAY_KEYS = ("domingo", "segunda", "terca", "quarta", "quinta", "sexta", "sabado")
COLOURS = ("branco", "vermelho", "verde", "roxo", "preto", "rosa", "roseo", "rosaceo", "dourado", "ouro")
NOTE = r"(?iu)abstin[êe]ncia|jejum|^primeir[ao]\b|^t[êe]mporas\b"
CLASS = r"(?iu)^\s*(\d)\s*[ªa°º]?\s*classe\s*$"
GLORIA_CREDO = r"(?iu)gl[óo]ria|credo|professio\s+fidei"
READINGS, JOINER = "•", " · "


def _names(values: tuple) -> Column:
    return F.array(*map(F.lit, values))


def blank(line: Column) -> Column:
    """Without content: empty, or dashes and dots alone."""
    return F.trim(line).rlike(r"^[-–—.\s]*$")


def _joined(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(lines, JOINER))


def day_cell(lines: Column, year: Column) -> Column:
    """struct(date 'YYYY-MM-DD', weekday, warning) of '1 de Julho' and a weekday; null for what is no date.

    The date decides the weekday; a published one that is missing, misspelt or another gives the warning.
    """
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    month = F.array_position(_names(MONTHS), F.trim(fold(F.regexp_extract(first, r"(?i)^(\d{1,2})\s+de\s+(.+)$", 2))))
    day = F.regexp_extract(first, r"(?i)^(\d{1,2})\s+de\s+(.+)$", 1).try_cast("int")
    date = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day).try_cast("date")
    weekday = F.get(_names(WEEKDAYS), F.dayofweek(date) - 1)
    said = F.get(F.split(F.trim(fold(F.coalesce(F.get(lines, F.lit(1)), F.lit("")))), r"[\s-]"), F.lit(0))
    at = F.array_position(_names(WEEKDAY_KEYS), said)
    warning = F.when(at == 0, "weekday unreadable").when(at != F.dayofweek(date), "weekday differs")
    return F.when((month > 0) & date.isNotNull(), F.struct(date.cast("string").alias("date"), weekday.alias("weekday"), warning.alias("warning")))


def feast_cell(lines: Column) -> Column:
    """struct(feast, commemoration, classis): the first line that is a class and nothing else is the class, the rest commemorations."""
    rest = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    at = F.array_position(F.transform(rest, lambda x: x.rlike(CLASS)), True)
    digit = F.regexp_extract(F.get(rest, (at - 1).cast("int")), CLASS, 1)
    classis = F.when(at > 0, F.concat(digit, F.lit("ª classe")))
    return F.struct(F.nullif(F.get(lines, F.lit(0)), F.lit("")).alias("feast"), _joined(F.filter(rest, lambda x, i: i != at - 1)).alias("commemoration"), classis.alias("classis"))


def marian_cell(lines: Column) -> Column:
    """struct(marian_saint, note): notes of discipline apart from saints."""
    held = F.filter(lines, lambda x: ~blank(x))
    return F.struct(_joined(F.filter(held, lambda x: ~x.rlike(NOTE))).alias("marian_saint"), _joined(F.filter(held, lambda x: x.rlike(NOTE))).alias("note"))


def is_colour(line: Column) -> Column:
    """All its parts between '/', ',' and 'ou' are colours."""
    parts = F.filter(F.transform(F.split(line, r"(?i)\s*(?:/|,|\bou\b)\s*"), lambda x: F.trim(fold(x))), lambda x: x != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda x: x.isin(list(COLOURS)))


def liturgy_cell(lines: Column) -> Column:
    """struct(color, gloria, credo, preface, epistle, gospel); a field's first line counts.

    A line counts for the first of preface, Gloria and Credo, colour, readings that it fits and that is still open.
    """
    none = F.struct(*(F.lit(None).cast(kind).alias(name) for name, kind in (("color", "string"), ("gloria", "boolean"), ("credo", "boolean"), ("preface", "string"), ("epistle", "string"), ("gospel", "string"))))

    def said(line: Column, what: str, without: str) -> Column:
        return F.when(line.rlike(rf"(?iu){what}"), ~line.rlike(rf"(?iu)sem\s+{without}"))

    def read(acc: Column, line: Column) -> Column:
        parts = F.filter(F.transform(F.split(line, READINGS), lambda x: F.trim(x)), lambda x: x != "")
        preface = acc["preface"].isNull() & line.rlike(r"(?iu)^pref[áa]cio\b")
        sung = ~preface & acc["gloria"].isNull() & line.rlike(GLORIA_CREDO)
        colour = ~preface & ~sung & acc["color"].isNull() & is_colour(line)
        texts = ~preface & ~sung & ~colour & acc["epistle"].isNull() & (F.size(parts) == 2)
        return F.struct(
            F.when(colour, line).otherwise(acc["color"]).alias("color"), F.when(sung, said(line, "gl[óo]ria", "gl[óo]ria")).otherwise(acc["gloria"]).alias("gloria"),
            F.when(sung, said(line, r"credo|professio\s+fidei", "credo")).otherwise(acc["credo"]).alias("credo"), F.when(preface, line).otherwise(acc["preface"]).alias("preface"),
            F.when(texts, F.get(parts, F.lit(0))).otherwise(acc["epistle"]).alias("epistle"), F.when(texts, F.get(parts, F.lit(1))).otherwise(acc["gospel"]).alias("gospel"),
        )

    return F.aggregate(F.filter(lines, lambda x: ~blank(x)), none, read)


CELLS = ("day_lines", "feast_lines", "marian_lines", "liturgy_lines")


def judged_rows(rows: DataFrame, year: str = "year") -> DataFrame:
    """rows with cells day_lines, feast_lines, marian_lines and liturgy_lines (arrays of strings, null for none), what was read of them, and reason: why a row is no day, null where it is one.

    Header rows are left out. A row without a date or a feast is a reject; days have warnings, an array. Other columns pass.
    """
    empty = F.array().cast("array<string>")
    cells = {name: F.filter(F.coalesce(F.col(name), empty), lambda x: x.isNotNull()) for name in CELLS}
    held = rows.filter(~F.coalesce(F.get(cells["day_lines"], F.lit(0)), F.lit("")).rlike("(?i)^dia$"))
    made = held.withColumns({"d": day_cell(cells["day_lines"], F.col(year)), "f": feast_cell(cells["feast_lines"]), "m": marian_cell(cells["marian_lines"]), "l": liturgy_cell(cells["liturgy_lines"])})
    reason = F.when(F.col("d").isNull(), "no date").when(F.col("f.feast").isNull(), "no feast")
    warnings = F.array_compact(F.array(F.col("d.warning"), F.when(F.col("l.color").isNull(), "no colour"), F.when(F.col("l.epistle").isNull() | F.col("l.gospel").isNull(), "no readings")))
    return made.select(*rows.columns, reason.alias("reason"), "d.date", "d.weekday", "f.*", "m.*", "l.*", warnings.alias("warnings"))


def read_rows(rows: DataFrame, year: str = "year") -> tuple[DataFrame, DataFrame]:
    """(days, rejects) of judged_rows, written once, so that pages aren't read for each of them."""
    told, _ = measured(judged_rows(rows, year))
    return told.filter("reason is null").drop("reason", *CELLS), told.filter("reason is not null").select(*rows.columns, "reason")


def measured(told: DataFrame) -> tuple[DataFrame, dict]:
    """(judged_rows as a table, how many days and rejects were counted while it was written)."""
    seen = Observation()
    table = kept(told.observe(seen, F.count_if(F.col("reason").isNull()).alias("days"), F.count_if(F.col("reason").isNotNull()).alias("rejects")), "days")
    return table, dict(seen.get)


def verdict(seen: dict, most: float = 0.1) -> dict:
    """days, rejects, ratio and abort: more than ``most`` of all rows were rejected, or there is no day."""
    ratio = seen["rejects"] / max(seen["days"] + seen["rejects"], 1)
    return {**seen, "ratio": ratio, "abort": ratio > most or not seen["days"]}


def publish(told: DataFrame, path: str, most: float = 0.1) -> dict:
    """Writes the days of judged_rows to path, one row a date, unless the run is to be aborted, and gives the verdict. Rows are read and counted in one pass."""
    table, seen = measured(told)
    found = verdict(seen, most)
    if not found["abort"]:
        last_wins(table.filter("reason is null").drop("reason", *CELLS)).write.mode("overwrite").parquet(path)
    return found


def resolved_year(url: Column, headings: Column, expected: Column) -> Column:
    """struct(year, warning): the address's year, else the first heading's, else the expected one; null outside 2000 to 2100."""
    from_url = F.regexp_extract(F.coalesce(url, F.lit("")), r"calendario-(\d{4})", 1).try_cast("int")
    said = F.transform(headings, lambda h: F.regexp_extract(h, r"\b(\d{4})\b", 1).try_cast("int"))
    found = F.coalesce(from_url, F.get(F.filter(said, lambda y: y.isNotNull()), F.lit(0)))
    year = F.coalesce(found, expected.cast("int"))
    warning = F.when(found.isNull(), "year not found").when(found != expected, "year differs")
    return F.struct(F.when(year.between(2000, 2100), year).alias("year"), warning.alias("warning"))


def page_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", expected: int | None = None, least: int = 0) -> DataFrame:
    """Rows for read_rows from the tables of calendar pages: id, position, year, year_warning and the four cells. Pages shorter than ``least`` characters are no calendar."""
    held = pages.filter(F.length(html_col) >= least)
    dated = read_tables(held, id_col, html_col, keep=(url_col,)).withColumn("__y", resolved_year(F.col(url_col), F.col("headings"), F.lit(expected).cast("int")))
    rows = dated.select(id_col, F.col("__y.year").alias("year"), F.col("__y.warning").alias("year_warning"), F.posexplode("rows").alias("position", "r"))
    return rows.select(id_col, "position", "year", "year_warning", *(F.get("r", F.lit(k)).alias(name) for k, name in enumerate(CELLS)))


def last_wins(days: DataFrame, date: str = "date", position: str = "position") -> DataFrame:
    """One row a date, the last one's, with repeated: whether the source had others."""
    made = days.groupBy(date).agg(F.max_by(F.struct(*days.columns), position).alias("r"), (F.count(F.lit(1)) > 1).alias("repeated"))
    return made.select("r.*", "repeated")


def new_days(batch: DataFrame, stored: DataFrame, date: str = "date") -> DataFrame:
    """Days that aren't stored yet. Of the stored ones only the batch's range is read."""
    ends = batch.agg(F.min(date).alias("a"), F.max(date).alias("b")).first()
    near = stored.filter(F.col(date).between(F.lit(ends["a"]), F.lit(ends["b"]))) if ends["a"] is not None else stored.limit(0)
    return batch.join(near.select(date).distinct(), date, "left_anti")


def months_present(days: DataFrame, date: str = "date") -> DataFrame:
    """One row: the months that have days, in order."""
    return days.agg(F.array_sort(F.collect_set(F.substring(date, 1, 7))).alias("months"))
