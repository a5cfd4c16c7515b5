"""Template residue, filler, error messages and script notices in the place of content.

Unfilled slots are found by one grammar per kind of delimiter. Code blocks are left out before looking, and a slot that
is quoted, or that the words around it speak about, is a mention and not residue. Filler, errors and notices count by
density: in a record where they are a whole value, in a page where they are the greater part of the visible text.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.sources.tables import table

#: Share of a page's visible letters that must be filler, error or notice for it to be the page's content.
DENSITY = 0.5

# The grammar of a slot's name, and of each kind of slot.
NAME = r"[A-Za-z_][\w.\-]*"
INNER = rf"\s{{0,3}}[#/^&>!-]?\s?{NAME}(?:\(\))?(?:\s?\|\s?[\w:'\", ]+)?\s{{0,3}}"
SLOTS = [
    rf"\{{\{{\{{{INNER}\}}\}}\}}",
    rf"\{{\{{{INNER}\}}\}}",
    rf"\{{%-?{INNER}(?:\s[\w.'\" =]+)?-?%\}}",
    rf"<%[=\-]?{INNER}[-]?%>",
    rf"\$\{{{INNER}\}}",
    rf"#\{{{INNER}\}}",
    rf"\[\[{INNER}\]\]",
    rf"@@{NAME}@@",
    rf"\*\|{NAME}\|\*",
    rf"<<{NAME}>>",
    rf"%\({NAME}\)[sd]",
    r"%(?!20|[0-9A-Fa-f][0-9]|[0-9][A-Fa-f])[A-Za-z_][\w.\-]{2,}%(?![0-9])",
    r"(?<![\w/])__[A-Za-z][A-Za-z0-9.]*(?:_[A-Za-z0-9.]+)*__(?!\w)",
    rf"(?<![\w{{$#\\]){{{NAME}}}(?![\w}}])",
    r"(?<![\w{$#\\])\{\d\}(?![\w}])",
]
SLOT = "|".join(f"(?:{x})" for x in SLOTS)
#: Words that speak about a slot rather than leave one, close before it or after it.
TALK_BEFORE = r"(?i)(?:\b(?:such as|like|write|type|enter|syntax|called|named|notation|e\.g\.|for example|zum Beispiel|par exemple|por ejemplo|comme|wie|tag|variable|placeholders?|Platzhalter)\s*[:(]?\s*|[`'\"“„«‘]\s?)$"
TALK_AFTER = r"(?i)^(?:\s?[`'\"”“»’]|\s+(?:is|are|means|stands for|placeholder|syntax|marks|ist ein|est un|es un)\b)"

# Words of filler Latin.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation "
    "ullamco laboris laborum nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident "
    "sunt culpa qui officia deserunt mollit anim id est".split()
)
# Filler that people and programs leave behind, whole values, any number of times over.
FILLER = [
    r"(?:your|the|product|insert|add|enter|put|place|type)?\s?(?:\w+\s){0,3}(?:goes|go|comes) here",
    r"(?:your|insert|add|enter|put|place|type|write|product|replace)\s(?:\w+\s){0,3}here", r"(?:headline|title|text|description|product|name|image)\s(?:\w+\s){0,2}here",
    r"(?:text|inhalt|beschreibung|titel) folgt(?: in kürze| demnächst| bald)?", r"hier (?:steht|kommt|folgt) (?:ihr|dein|der|ein|die) \w+(?: hin)?", r"ihr text hier|platzhalter(?:text)?|blindtext|mustertext",
    r"votre (?:texte|titre|description|contenu)(?: ici)?", r"(?:texte|titre|contenu) (?:ici|à venir|de remplissage)", r"(?:insérez|saisissez|entrez) (?:ici )?(?:votre|le|un) \w+(?: ici)?",
    r"(?:escriba|inserte|introduzca|ponga|escribe) aquí (?:su|el|la|tu|un|una) \w+", r"su (?:texto|título) aquí|(?:texto|título|descripción) (?:de ejemplo|de relleno|aquí)",
    r"(?:sample|dummy|placeholder|filler|example) (?:text|copy|content|title)(?:\s?[–—:,-]\s?(?:please )?(?:replace|change|delete|remove) (?:me|this))?", r"placeholder|untitled(?: (?:document|page|post))?(?: \(?copy\)?(?: \d+)?)?|new (?:page|post) \(?copy\)?",
    r"(?:add|insert|enter|write|put|type|paste|supply|provide) (?:your |the |a |an |some )?(?:\w+ )?(?:copy|text|content|title|headline|name|description|price|image|summary|body|blurb)(?: (?:here|later|soon))?",
    r"(?:todo|tbd|fixme)\b[^.!?…\n]*", r"(?:undefined|null|nan|none|nil)(?:[\s,]+(?:undefined|null|nan|none|nil)){0,5}", r"\[object \w+\](?:,\s?\[object \w+\])*", r"(?:asdf|qwer|qwerty|jkl|foo|bar|baz)(?:[\s,]*(?:asdf|qwer|qwerty|jkl|foo|bar|baz|ty))*",
    r"abc(?: def)(?: ghi)?(?: jkl)?", r"(?:test|x{2,}|bla+h?|dummy)(?:[\s,]+(?:test|x{2,}|bla+h?|dummy|copy|text|\d+))*", r"(?:text)(?:[\s,]+text)+", r"dummy (?:copy|text)(?:[\s,]+dummy (?:copy|text))*",
]
# How error messages begin, by language.
ERRORS = [
    r"(?:http )?(?:error |status )?[45]\d\d\s?(?:error\b|[–—:|-]\s(?!\d)|(?:page )?not found|forbidden|unauthorized|bad gateway|service|internal|gateway|access|too many|we )", r"error [45]\d\d\s?[:–—.-]", r"error [45]\d\d$",
    r"(?:oops|uh[- ]oh|whoops|sorry)\W{1,3}(?:something|an? |we |the |this |that )", r"something went wrong", r"an (?:unexpected |internal |unknown )?error (?:has )?occurred", r"(?:internal|unexpected) (?:server )?error\b", r"bad gateway|gateway time-?out|request time(?:d )?-?out",
    r"(?:this |the )?(?:page|file|document|resource|item|product)s? (?:was |could |can|is )?not (?:be )?found", r"(?:we )?(?:could not|couldn't|cannot|can't) find (?:that|the|this) (?:page|file|document)", r"(?:this |our |the )?(?:site|website|service|server|page) is (?:currently |temporarily |now )?(?:down|unavailable|offline|under (?:planned )?maintenance)", r"(?:service|site|page) (?:is )?(?:temporarily |currently )?unavailable",
    r"(?:your )?session (?:has )?(?:expired|timed out)", r"too many requests", r"(?:access|permission) (?:is |was )?(?:denied|forbidden)", r"you do(?: not|n't) have permission", r"(?:connection|connecting) to (?:the )?(?:database|server|host|upstream)[^.!?…\n]*?(?:failed|refused|lost|timed out)", r"(?:fatal|database|parse|syntax) error\b\s?[:(-]", r"(?:checking|verifying) (?:that|if|whether) you are (?:not a robot|human|a human)", r"(?:please )?(?:complete|solve) the (?:captcha|security check)",
    r"erreur(?: \d{3})?\s?:", r"erreur (?:interne|\d{3}|de (?:serveur|base|connexion))", r"(?:cette )?page (?:introuvable|non trouvée|n'existe pas)", r"(?:le )?service (?:est )?(?:momentanément|temporairement|actuellement)? ?indisponible", r"accès (?:refusé|interdit)", r"votre session a expiré", r"trop de requêtes",
    r"(?:die )?(?:angeforderte )?seite (?:wurde )?nicht gefunden", r"(?:der )?(?:dienst|server|seite) (?:ist )?(?:zurzeit|derzeit|vorübergehend|momentan) nicht (?:verfügbar|erreichbar)", r"zugriff (?:wurde )?verweigert", r"(?:interner )?serverfehler|fehler [45]\d\d|ein fehler ist aufgetreten", r"ihre sitzung ist abgelaufen", r"zu viele anfragen",
    r"(?:la )?página (?:solicitada )?no (?:encontrada|existe|se encuentra|fue encontrada|se ha encontrado)", r"error (?:interno|del servidor)", r"(?:el )?servicio (?:está )?(?:temporalmente |momentáneamente )?no disponible", r"acceso (?:denegado|prohibido)", r"(?:su|la) sesión ha (?:caducado|expirado)", r"demasiadas solicitudes",
]
# How notices that scripts are required begin, by language.
NOTICES = [
    r"(?:please |you (?:need|have|must) (?:to )?|to (?:continue|use this (?:site|app|page)),? (?:please )?)(?:enable|activate|turn on|allow|switch on) (?:java)?scripts?", r"enable (?:java)?scripts? (?:to|and reload|in your browser)", r"javascript (?:is|has been|seems to be|must be|needs to be)? ?(?:disabled|required|turned off|switched off|not enabled|deactivated|enabled)",
    r"(?:this |our |the )?(?:app|site|page|website|application) (?:does not|doesn't|will not|won't|cannot) (?:work|run|function|load)(?: \w+)? without (?:java)?scripts?", r"(?:this |our |the )?(?:app|site|page|website) (?:requires|needs) (?:java)?scripts?", r"loading\W{1,4}\s?if nothing happens", r"(?:your browser (?:does not|doesn't|cannot|can't) (?:support|run|execute|allow|load)|we're sorry but [^.!?…\n]+? doesn't work without) (?:java)?scripts?",
    r"(?:veuillez|merci d')\s?(?:activer|autoriser) (?:java)?scripts?", r"javascript (?:est|doit être) (?:désactivé|requis|nécessaire|activé)", r"activez javascript", r"(?:bitte )?(?:aktivieren|schalten|erlauben) sie (?:bitte )?(?:java)?s[ck]ripte?", r"javascript ist (?:deaktiviert|erforderlich|ausgeschaltet)|(?:diese seite|diese app) (?:benötigt|braucht|funktioniert nicht ohne) javascript",
    r"(?:por favor,? )?(?:active|habilite|activa|habilita) (?:java)?scripts?\b", r"javascript está (?:desactivado|deshabilitado)|(?:se requiere|necesita(?: activar| habilitar)?) javascript", r"(?:debe|necesita) (?:activar|habilitar) javascript",
]
TAIL = r"\s*(?:\(?\b(?:ref|reference|incident|request|code|id|referenz|référence)\b\.?[^)]*\)?\.?\s*)?$"
#: Signs that stand around filler.
EDGES = " \t-–—*_~<>[](){}«»\"'“”#=+|/"
CODE = r"(?is)<(script|style|template|svg|pre|code|samp|kbd|tt|textarea|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)"
BLOCK = r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|table|thead|tbody|tr|td|th|section|article|main|header|footer|nav|aside|figure|figcaption|blockquote|dl|dt|dd|hr|br|noscript|form|title|body|html|option|select)\b[^>]*>"
#: One message is short; a longer text is taken sentence by sentence, as what begins like a message may be about something.
MESSAGE = 220
SENTENCE = r"(?<=[.!?…])\s+|\n+"


class Residue:
    """The compiled grammars; remembers the short texts it has judged."""

    KEEP = 100_000

    def __init__(self):
        self.seen: dict[str, str | None] = {}
        self.sentence, self.trailer = re.compile(SENTENCE), re.compile(r"(?i)\(?(?:ref|reference|incident|request|trace|code|id|referenz|référence)\b[^\s\w]*(?:\s(?:no|nr|id)\b\.?)?\s*:?\s*\S*\d")
        self.unit = re.compile("(?i)(?:" + "|".join(FILLER) + r")(?:[.!…:\s]+|$)")
        self.slot, self.before, self.after = re.compile(SLOT), re.compile(TALK_BEFORE), re.compile(TALK_AFTER)
        self.slot_cue = re.compile(r"[{<\[@*%_$#](?:[{<\[@|%_(]|[A-Za-z0-9])")
        self.filler = re.compile("(?i)(?:(?:" + "|".join(FILLER) + r")[.!…:\s]*)+")
        self.error = re.compile("(?i)[^\\w¡¿]*(?:" + "|".join(ERRORS) + ")")
        self.notice = re.compile("(?i)[^\\w¡¿]*(?:" + "|".join(NOTICES) + ")")
        self.tail = re.compile("(?i)" + TAIL)
        self.words = re.compile(r"[^\W\d_]+")
        self.head = re.compile(r"(?is)<h1\b[^>]*>(.*?)</h1\s*>")
        self.code, self.block, self.tag = re.compile(CODE), re.compile(BLOCK), re.compile(r"</?[A-Za-z][^<>]*>|<!DOCTYPE[^>]*>")

    def has_slot(self, text: str) -> bool:
        """A slot that is left in the text, not one that the text speaks about."""
        if not self.slot_cue.search(text):
            return False
        for m in self.slot.finditer(text):
            around = text[max(0, m.start() - 30) : m.start()], text[m.end() : m.end() + 20]
            whole = not around[0].strip() and not around[1].strip()
            if whole or not (self.before.search(around[0]) or self.after.search(around[1])):
                return True
        return False

    def message(self, text: str) -> str | None:
        """filler, error or notice, where the text is nothing else; of a longer one, where most of its letters are."""
        text = text.strip()
        if len(text) > MESSAGE:
            return self.latin(text) or self.longer(text)
        if text not in self.seen:
            if len(self.seen) >= self.KEEP:
                self.seen.clear()
            self.seen[text] = (self.short(text) or self.latin(text)) if text else None
        return self.seen[text]

    def short(self, text: str) -> str | None:
        if not text[0].isdigit() or text[0] in "45":
            if self.notice.match(text):
                return "notice"
            if self.error.match(text):
                return "error"
            bare = self.tail.sub("", text)
            if text.lower() != "none" and (self.filler.fullmatch(bare) or bare[:1] in EDGES and (bare := bare.strip(EDGES)) and self.filler.fullmatch(bare)):
                return "filler"
        return None

    def longer(self, text: str) -> str | None:
        """By the share of sentences that are messages; references behind an error are no text of their own."""
        size, weight = 0, {}
        for x in filter(None, map(str.strip, self.sentence.split(text))):
            if self.trailer.match(x):
                continue
            kind, n = (self.short(x) or self.latin(x), len(x)) if len(x) <= MESSAGE else ("filler", self.units(x))
            size += len(x)
            if kind and n:
                weight[kind] = weight.get(kind, 0) + n
        return max(weight, key=weight.get) if weight and sum(weight.values()) >= DENSITY * size else None

    def units(self, text: str) -> int:
        """Signs of the filler phrases, one after the other, that a text begins with."""
        at = 0
        while at < len(text) and (m := self.unit.match(text, at)) and m.end() > at:
            at = m.end()
        return at

    def latin(self, text: str) -> str | None:
        """filler, where the words are filler Latin or one or two words over and over."""
        words = self.words.findall(text.lower())
        if len(words) >= 3:
            latin = sum(w in LATIN for w in words)
            if latin >= 0.7 * len(words) and ("lorem" in words or "ipsum" in words or len({w for w in words if w in LATIN and len(w) > 3}) >= 2):
                return "filler"
            kinds = set(words)
            if len(kinds) <= 2 and len(words) >= 2 * len(kinds) and all(w.isascii() and len(w) < 12 for w in kinds) and not any(c.isdigit() for c in text):
                return "filler"
        return None

    def record(self, payload: str | None, loads=json.loads) -> str | None:
        """Kind of residue in a payload's values; nested values count too. Broken JSON is looked at as one text."""
        if not payload:
            return None
        try:
            todo = [loads(payload)]
        except (ValueError, RecursionError):
            return "slot" if self.has_slot(payload) else None
        texts = []
        while todo:
            x = todo.pop()
            if type(x) is str:
                texts.append(x)
            elif type(x) is dict:
                todo.extend(x.values())
            elif type(x) is list:
                todo.extend(x)
        both = "\n".join(texts)
        if self.slot_cue.search(both) and any(map(self.has_slot, texts)):
            return "slot"
        for x in texts:
            if kind := self.message(x):
                return kind
        return None

    def blocks(self, page: str) -> list[str]:
        """Visible text of a page, block by block, without code."""
        page = self.code.sub(" ", page) if "<" in page else page
        out = []
        for part in self.block.split(page):
            text = html.unescape(self.tag.sub(" ", part) if "<" in part else part).strip()
            if text:
                out += [x for x in re.split(r"\n{2,}", text) if x.strip()]
        return out

    def page(self, page: str | None) -> str | None:
        """Kind of residue that is left in a page, or that is its content."""
        if not page or page.isspace():
            return None
        blocks = self.blocks(page)
        if any(self.has_slot(x) for x in blocks):
            return "slot"
        size, weight = 0, {}
        heads = {" ".join(html.unescape(self.tag.sub(" ", x)).split()) for x in self.head.findall(page)}
        for x in blocks:
            if kind := self.message(x):
                weight[kind] = weight.get(kind, 0) + len(x)
            elif " ".join(x.split()) in heads:
                continue  # a title is no content of its own
            size += len(x)
        if weight and sum(weight.values()) >= DENSITY * size:
            return max(weight, key=weight.get)
        return None


@F.pandas_udf(T.StringType())
def residue(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(is_page, text) to slot, filler, error, notice or null."""
    found = Residue()
    for is_page, text in batches:
        yield pd.Series([(found.page if p else found.record)(x if isinstance(x, str) else None) for p, x in zip(is_page, text, strict=True)], dtype=object)


def _judged(spark, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "extracted_record").select(F.lit("extracted_record").alias("tbl"), F.col("record_id").alias("item_id"), F.lit(False).alias("page"), F.col("payload").alias("text"))
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("tbl"), F.col("page_id").cast("string").alias("item_id"), F.lit(True).alias("page"), F.col("cleaned_html").alias("text"))
    return records.unionByName(pages).select("tbl", "item_id", residue("page", "text").alias("kind"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """tbl, item_id of every record and page with residue. Null, empty and blank texts are no cases; every row counts."""
    return _judged(spark, sf_dir).filter("kind IS NOT NULL").select("tbl", "item_id")


def p3_kept(spark, sf_dir: str) -> DataFrame:
    """tbl, item_id of all rows that are fit to be kept."""
    return _judged(spark, sf_dir).filter("kind IS NULL").select("tbl", "item_id")
