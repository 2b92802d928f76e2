"""Model answers as column expressions: reasoning removed, blocks or JSON read, verdicts with their divergences filtered."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tags as clean_tags

# The markers of an answer's blocks and the names that also pass.
TITLE, DEK, CATEGORY, TAGS, BODY = "TITULO|TÍTULO|HEADLINE", "DEK|LINHA DE APOIO|SUBTITULO|SUBTÍTULO", "CATEGORIA", "TAGS", "CORPO|BODY|CORPO_MD|TEXTO"
# Complaints that the text leaves something out, and complaints about mere translation.
OMISSION = (
    r"(?iu)\b(n[ãa]o\s+(menciona|inclui|informa|cita|especifica|detalha|traz|apresenta|indica|refere|reproduz|explicita|fornece|d[áa]|descreve|elenca|lista|quantifica|nomeia|identifica|aborda|contempla|reflete|abrange)"
    r"|omit[ei]|omiss[ãa]o|deixa\s+de\s+\w+|falta\s+(a|o|mencionar|informar)|ausente\s+n[ao]\s+vers[ãa]o|apenas\s+menciona|se\s+limita\s+a)"
)
TRANSLATION = (
    r"(?iu)\b(formato\s+(de\s+)?(data|n[úu]mero|hora)|formato\s+diferente|apenas\s+(uma\s+)?(tradu|reformul|adapta)|tradu(ção|zido|zida|z-se)|reescrit[ao]|reformula(do|da|ção)|equivalente\s+em\s+portugu[êe]s"
    r"|mesma\s+(data|informa[çc][ãa]o|ideia)|corresponde\s+ao\s+original|vers[ãa]o\s+(mais\s+)?(curta|concisa|resumida))"
)
# What may stand around a marker, and the names of fences.
_DECOR = r"[*_\s>#\-\"']*"
DRAFT_JSON = "titulo string, dek string, corpo_md string, categoria string, tags array<string>"


def without_reasoning(c: Column) -> Column:
    """Without <think> blocks; an open one that is never closed takes the rest with it."""
    closed = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(closed, r"(?is)<think>.*$", ""))


def unfenced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^```(?:json|markdown|md|text)?\s*", ""), r"\s*```\s*$", ""))


def json_candidates(c: Column) -> Column:
    """The whole answer, the answer without its fence, and what stands between the outer braces."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.array(F.trim(c), unfenced(c), inner)


def _line(c: Column, names: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(c, rf"(?imu)^[*_\s>#-]*(?:{names})\s*:\s*([^\n]*)", 1), r"\*+$", ""))


def read_draft(answer: Column) -> Column:
    """struct(title, dek, body, category, tags) of an answer in blocks, else of its JSON; null where neither can be read.

    Blocks need a title and a body; JSON needs titulo, dek and corpo_md. Null and empty answers give null.
    Decoration before a marker and asterisks at a line's end go; bold that closes right after the colon stays in the value.
    """
    text = unfenced(without_reasoning(answer))
    body = F.trim(F.regexp_extract(text, rf"(?imu)^[*_\s>#-]*(?:{BODY})\s*:\s*([\s\S]*)", 1))
    title = _line(text, TITLE)
    listed = F.transform(F.split(_line(text, TAGS), "[,;]"), lambda t: F.regexp_replace(t, r"^[-*\s]+", ""))
    made = lambda t, d, b, k, g: F.struct(t.alias("title"), d.alias("dek"), b.alias("body"), F.lower(F.trim(k)).alias("category"), clean_tags(g).alias("tags"))
    blocks = F.when((title != "") & (body != ""), made(title, _line(text, DEK), body, _line(text, CATEGORY), listed))
    parsed = F.transform(json_candidates(without_reasoning(answer)), lambda t: F.from_json(t, DRAFT_JSON))
    first = F.get(F.filter(parsed, lambda j: j["titulo"].isNotNull() & j["dek"].isNotNull() & j["corpo_md"].isNotNull()), F.lit(0))
    found = made(F.trim(first["titulo"]), F.trim(first["dek"]), F.trim(first["corpo_md"]), F.coalesce(first["categoria"], F.lit("")), F.coalesce(first["tags"], F.array().cast("array<string>")))
    return F.coalesce(blocks, F.when(first.isNotNull(), found))


def real_divergences(found: Column) -> Column:
    """Divergences without complaints about omissions and mere translation."""
    return F.filter(F.transform(found, lambda d: F.trim(d)), lambda d: (d != "") & ~d.rlike(OMISSION) & ~d.rlike(TRANSLATION))


def _verdict_json(answer: Column) -> Column:
    """struct(consistent, divergences) of an object whose keys are read in any letter case; the verdict is a word or a boolean."""
    keyed = F.transform(json_candidates(answer), lambda t: F.transform_keys(F.from_json(t, "map<string,string>"), lambda k, v: F.lower(F.trim(k))))
    said = lambda m: F.coalesce(m["consistente"], m["veredito"])
    first = F.get(F.filter(keyed, lambda m: m.isNotNull() & said(m).isNotNull()), F.lit(0))
    listed = F.from_json(F.coalesce(first["divergencias"], first["divergencia"]), "array<string>")
    yes = F.lower(F.trim(said(first))).isin("consistente", "true")
    return F.when(first.isNotNull(), F.struct(yes.alias("consistent"), F.coalesce(listed, F.array().cast("array<string>")).alias("divergences")))


def filtered(verdict: Column) -> Column:
    """The verdict without divergences that don't count; consistent where none is left of some."""
    left = real_divergences(verdict["divergences"])
    return F.when(verdict.isNotNull(), F.struct((verdict["consistent"] | (F.size(left) == 0)).alias("consistent"), left.alias("divergences")))


def read_verdict(answer: Column) -> Column:
    """struct(consistent, divergences): VEREDITO and the lines over 12 characters below DIVERGENCIAS, else JSON; null without a verdict, which fails.

    Anything but CONSISTENTE counts as divergent. Where only complaints are left that don't count, the text is consistent.
    """
    text = unfenced(without_reasoning(answer))
    verdict = F.regexp_extract(text, rf"(?imu)^{_DECOR}VEREDITO\"?\s*:\s*[\"']?\s*(\w+)", 1)
    listed = F.regexp_extract(text, rf"(?imu)^{_DECOR}DIVERG[ÊE]NCIAS?\"?\s*:([\s\S]*)", 1)
    lines = F.filter(F.transform(F.split(listed, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[\s*_>#-]+", ""))), lambda x: F.length(x) > 12)
    by_line = F.when(verdict != "", F.struct((F.lower(verdict) == "consistente").alias("consistent"), lines.alias("divergences")))
    return filtered(F.coalesce(by_line, _verdict_json(without_reasoning(answer))))
