"""Records that hold template residue, filler, error or challenge messages, or demands for scripts in place of content.

Slots are induced by aligning lines of one template over all records. A line with a placeholder is taken without it; if
other records fill the place with something else it is a slot left unfilled, while a text that explains a placeholder holds
the same one wherever its other words vary. What looks like a variable's name, or like nothing at all before a comma, is a
slot if other records put different words there. Whole-page messages are lines that recur over pages which have no sentence
of their own; a list of common wordings adds those too rare to be induced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm import codepoints as C
from pagelore.llm import pagelines as P
from pagelore.session import cut

#: A line is an induced page message if it stands on at least so many pages without content, and those are at least this share of its pages.
MESSAGE_PAGES, MESSAGE_SHARE = 2, 0.4
#: A sentence on fewer pages than RECURS is a page's own; it is content from so many letters on.
RECURS, CONTENT_LETTERS = 3, 40
#: From so many letters on, a page's own sentence that has a common wording speaks about it.
SPEAKS_LETTERS = 60
#: Records that must fill a place with different words before a name or a blank there counts as an unfilled slot.
FILLS = 3
#: A line explains its placeholder if, where another word varies over pages, so great a share of them hold the same placeholder, and
#: so many pages do.
SAME, EXPLAINED = 0.8, 3

# --- fixed values: common wordings (case-folded), in English, German, French, Spanish and Korean ------------------
SCRIPT = r"(?:javascript|java script|scripts?\b|자바스크립트|스크립트)"
WORDINGS = [
    # demands to switch scripts on
    rf"^(?:please |you need to |you must |to continue,? )*(?:enable|turn on|switch on|activate|allow) {SCRIPT}", rf"\b(?:enable|turn on|allow) {SCRIPT} (?:to|for|in your)",
    rf"^(?:this|our) (?:site|page|app|website)\b.{{0,20}} (?:requires?|needs) {SCRIPT}", rf"^{SCRIPT} (?:is|are|must be|has to be) (?:required|disabled|needed|enabled|switched|turned)",
    rf"\bdoes not support {SCRIPT}", rf"\bbitte (?:aktivieren|schalten|erlauben)\b.*{SCRIPT}", rf"^(?:diese seite|dieser inhalt) (?:benötigt|braucht|erfordert) {SCRIPT}",
    rf"\b(?:veuillez activer|activez|merci d'activer) {SCRIPT}", rf"^(?:cette page|ce site) (?:requiert|nécessite|exige) {SCRIPT}",
    rf"^(?:por favor,? )?(?:active|activa|habilite|habilita) {SCRIPT}", rf"^(?:esta página|este sitio) (?:requiere|necesita) {SCRIPT}",
    rf"{SCRIPT}.{{0,10}}(?:켜 주세요|활성화|허용|필요)", r"^loading (?:application|app|page)\b",
    # status lines
    r"^(?:http|error|status|status code|fehler|erreur|código|오류)?(?:\s*(?:code|no|nr))?[\s:.#]*[1-5]\d\d(?:\s*[:–—-])?(?:$|\s+(?:bad request|unauthorized|forbidden|not found|gone|too many|internal|bad gateway|service unavail|gateway time|something|page not|error))",
    r"^(?:sorry, )?error (?:number|code|no\.?) \d+", r"\b(?:internal server error|bad gateway|service unavailable|gateway timeout|too many requests)\b", r"\brequest failed with (?:status|code)",
    r"^(?:page|file|resource|site|document) not found", r"\b(?:page|url|address|file) (?:you (?:asked for|requested|are looking for)|that brought you here) (?:does not exist|could not|cannot|was not|has been|may|is not|no longer)",
    r"^(?:access|permission) denied\b", r"^forbidden$", r"\bdo not have (?:permission|access|the rights?) to (?:view|see|access|open)", r"\byour (?:ip|address|account|client) has been (?:rate limited|blocked|banned)",
    r"^oops\b", r"^(?:sorry, )?something (?:went wrong|broke)", r"\bwe are (?:down for maintenance|currently undergoing maintenance)", r"^(?:your|this) session (?:has|is) (?:expired|timed out)",
    r"^this (?:site|page) can(?:'|no)?t be reached", r"\bconnection (?:was|has been) (?:reset|refused|closed|timed out)", r"\btry again (?:in a few|later)", r"^(?:the )?(?:server|origin|upstream)\b.*\b(?:unexpected condition|did not answer|invalid response|not respond)",
    r"\bseite (?:wurde )?nicht gefunden", r"\bangeforderte (?:seite|adresse)\b", r"\bzugriff verweigert", r"\bpage (?:introuvable|non trouvée)", r"\b(?:accès|acces) (?:refusé|interdit)", r"\bl'adresse demandée n'existe", r"\bpágina no encontrada", r"\bacceso denegado", r"\bno está autorizado\b", r"찾을 수 없", r"접근이 거부|권한이 없",
    # challenges
    r"\b(?:verify|confirm|prove) (?:that )?you are (?:a |an )?(?:human|person|not a (?:robot|script))", r"\bchecking your browser", r"\bunusual traffic\b", r"\bslide the bar\b", r"^(?:complete|solve) the (?:captcha|puzzle|challenge)", r"\bare you a (?:human|robot)\b",
    # traces of programs
    r"^traceback \(most recent call last\)", r"^(?:\w+\.)+\w*(?:exception|error)\b", r"^\w*(?:error|exception): ", r"^(?:fatal error|uncaught|unhandled|segmentation fault)\b", r"\bat [\w.$]+\([\w.]+:\d+\)", r"^stack trace\b", r"^undefined$", r"^null$", r"^nan$",
    # filler
    r"\blorem ipsum\b", r"\b(?:sample|dummy|placeholder|filler) (?:text|copy|content|heading|title)\b", r"^placeholder\b", r"^(?:insert|enter|type|add|put) your (?:own )?(?:text|content|heading|title|copy)\b", r"^your (?:headline|title|text|heading|content) (?:goes )?here", r"^todo\b", r"\basdf\b.*\basdf\b", r"^(?:test ){2,}",
    r"\bbeispieltext\b", r"\bplatzhalter(?:text)?\b", r"\bblindtext\b", r"\btexte? (?:d'exemple|de remplissage|factice)\b", r"\btexto de (?:relleno|ejemplo|prueba)\b", r"내용을 (?:여기에 )?입력|여기에 (?:내용|텍스트|제목)",
]
#: Words of the Latin filler; a line made of them is filler.
LATIN = set("""lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim
veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu
fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum""".split())
#: Times in the notations the records use: date and clock with T or blank, fraction, any offset; or seconds since 1970.
TIME = r"^\s*(?:\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[Tt ](?:[01]\d|2[0-4]):[0-5]\d(?::(?:[0-5]\d|60)(?:[.,]\d+)?)?\s*(?:[Zz]|[Uu][Tt][Cc]|[Gg][Mm][Tt]|[+-]\d{2}(?::?\d{2})?)?)?|[+-]?\d{9,10}(?:\.\d+)?|\d{12,13})\s*$"
#: Names that templates give to what they fill in, and what they put there by default.
VARIABLES = """first_name firstname last_name lastname full_name fullname user_name username your_name yourname customer_name customername company_name
companyname product_name productname site_name sitename page_title pagetitle email_address emailaddress phone_number phonenumber order_id orderid
xxx xxxx""".split()
# --- end of fixed values ------------------------------------------------------------------------------------------
_WORDINGS = re.compile("|".join(f"(?:{x})" for x in WORDINGS))
#: A linear pattern that holds wherever a wording may, and one for the filler.
_MAYBE = "|".join(f"(?:{x})" for x in WORDINGS).replace(r"\b", "")
_MAYBE_LATIN = "|".join(sorted(w for w in LATIN if len(w) >= 4))
_SCRIPT = re.compile(SCRIPT + "|^loading ")
#: Names of variables without brackets, in the form before folding; a place that holds nothing.
_IDENTIFIER = re.compile(r"(?<![\w@./])(?:[~:|^=]{1,2}[A-Za-z][\w.\-]*[~:|^=]{1,2}|[a-z]+(?:_[a-z]+)+|[A-Z]+(?:_[A-Z]+)+|[a-z]+[A-Z][a-z]+[A-Za-z]*|(?i:" + "|".join(VARIABLES) + r"))(?![\w@/])")
_MAYBE_IDENTIFIER = r"[~:|^=][A-Za-z][\w.\-]*[~:|^=]|[A-Za-z]_[A-Za-z]|[a-z][A-Z][a-z]|(?i:" + "|".join(VARIABLES) + ")"
_SLOTS = re.compile(rf"{P.SLOT}(?:\s*{P.SLOT})+")
_BLANK = re.compile(r"(?:(?<=\s)|^)(?=,(?:\s|$))|(?<=,)\s*(?=,)|(?<=\()\s*(?=\))")
_MAYBE_BLANK = r"(?:^|\s),(?:\s|$)|,\s*,|\(\s*\)"


def _worded(line: str) -> bool:
    if _WORDINGS.search(line):
        return True
    words = P.LETTERS.findall(line)
    return len(words) >= 4 and sum(w in LATIN for w in words) >= 0.9 * len(words)


def worded(lines: pa.Array) -> np.ndarray:
    """Lines that have a common wording of a message, demand or filler."""
    maybe = np.flatnonzero(P.hits(lines, _MAYBE) | P.hits(lines, _MAYBE_LATIN))
    out = np.zeros(len(lines), bool)
    if len(maybe):
        # most of these are the same few lines
        d = pc.dictionary_encode(lines.take(pa.array(maybe)))
        out[maybe] = np.array([_worded(v) for v in d.dictionary.to_pylist()], bool)[d.indices.to_numpy()]
    return out


def messages(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which of the bare lines are messages by their wording, with or without a label, and which demand scripts."""
    plain, labelled = P.unlabelled(lines)
    plain = P.bare(plain)
    out = worded(plain)
    out[labelled] |= worded(lines.take(pa.array(labelled, pa.int64())))
    script = np.zeros(len(lines), bool)
    for i in np.flatnonzero(out).tolist():
        script[i] = bool(_SCRIPT.search(plain[i].as_py()) or _SCRIPT.search(lines[i].as_py()))
    return out, script


class Templates:
    """Hashes of the words of lines in order, and of each line with one word masked."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray):
        self.size = np.diff(ends)
        self.line = np.repeat(np.arange(len(self.size)), self.size)
        with np.errstate(over="ignore"):
            self.place = (np.arange(len(flat)) - ends[self.line] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.terms = self._term(flat)
        self.whole = C._mix(self.size.astype(np.uint64))
        some = self.size > 0
        if some.any():
            self.whole[some] ^= np.bitwise_xor.reduceat(self.terms, ends[:-1][some])

    def _term(self, words: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return C._mix(np.asarray(words, np.int64).view(np.uint64) ^ self.place)

    def hashes(self) -> np.ndarray:
        return self.whole.view(np.int64)

    def masked(self, word: int) -> np.ndarray:
        """For each word of each line the line's hash with `word` in its place."""
        return (self.whole[self.line] ^ self.terms ^ self._term(word)).view(np.int64)


def sublists(n: int, of: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """Of n rows, and an empty one after them, the `values` whose `of` is the row; `of` ascends."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n + 1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))


FIELDS = "line_no int, host long, strong boolean, weak boolean, worded boolean, sentence boolean, weight long, h long, tmpl long, fill long, wild array<long>, probes array<long>"


def line_looks(df: DataFrame, key: str, page: str, url: str, text: str) -> DataFrame:
    """Every line of the texts: h, the hash of its letters without label and placeholders; whether it has a placeholder (strong), what
    may be a variable's name or a blank (weak), a common wording, or is a sentence. Of lines with a placeholder: the template
    (tmpl) and what fills it, and the template with each other word masked (wild). Of all others, whatever their length and
    wording: the template with each word taken for the slot (probes)."""
    src = df.select(F.col(key), F.col(page), F.col(url), F.col(text)).toDF("key", "page", "url", "text").where("text is not null")
    t = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    names = ["key", "page", *(c.split()[0] for c in FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, wild = (int(v) for v in P.word_hash([P.SLOT, "anyword"]))
        for b in C.pieces(batches):
            urls = b.column(2).to_pylist()
            x = P.read(b.column(3), [P.brand_of(u) for u in urls])
            host = P.word_hash([P.host_of(u) for u in urls])
            open_, labelled = P.unlabelled(x.text)
            bare = P.bare(open_)
            n = len(bare)
            strong = np.zeros(n, bool)
            strong[list(x.slots)] = True
            said = worded(bare)
            said[labelled] |= worded(P.bare(x.text.take(pa.array(labelled, pa.int64()))))
            fill, tmpl = np.zeros(n, np.int64), np.zeros(n, np.int64)
            fills = {i: "\x03".join(v) for i, v in x.slots.items()}
            lines = {i: bare[i].as_py() for i in x.slots}
            weak = np.zeros(n, bool)
            for i in np.flatnonzero((P.hits(x.raw, _MAYBE_IDENTIFIER) | P.hits(x.raw, _MAYBE_BLANK)) & ~strong).tolist():
                raw = x.raw[i].as_py()
                found = _IDENTIFIER.findall(raw)
                line = (_IDENTIFIER.sub(f" {P.SLOT} ", raw) if found else _BLANK.sub(f" {P.SLOT} ", raw)).casefold()
                if P.SLOT in line and len(P.LETTERS.findall(line)) > 2:
                    weak[i], lines[i], fills[i] = True, line.strip(P._EDGE.replace("\\", "")), "\x03".join(found)
            h, weight = P.letters(bare)
            sentence = P.stops(open_) & (weight >= P.SENTENCE_LETTERS)
            # every line is aligned, of any length: an array holds as many hashes as its line has words
            slotted = strong | weak
            masked = P.replaced(bare, list(lines), [_SLOTS.sub(f" {P.SLOT} ", v) for v in lines.values()])
            flat, ends = P.words(masked, numbers=True)
            made = Templates(flat, ends)
            tmpl[slotted] = made.hashes()[slotted]
            if fills:
                fill[list(fills)] = P.word_hash(list(fills.values()))
            of = made.line
            # a word is only taken for a varying one among at least three others
            others = np.bincount(made.line, weights=flat != slot, minlength=len(made.size))[made.line]
            w = strong[of] & (flat != slot) & (others > 3)
            wilds = sublists(n, of[w], made.masked(wild)[w])
            w = ~slotted[of] & (made.size[of] > 2)
            probes = sublists(n, of[w], made.masked(slot)[w])
            keep = np.flatnonzero((P.filled(bare) | strong | weak)[x.which])
            at, which = pa.array(x.row[keep]), x.which[keep]
            # a template is probed where its line stands first
            first = np.zeros(len(keep), bool)
            first[np.unique(which, return_index=True)[1]] = True
            lists = [wilds.take(pa.array(which)), probes.take(pa.array(np.where(first, which, n)))]
            cols = [x.no.astype(np.int32), host[x.row], *(v[x.which] for v in (strong, weak, said, sentence, weight, h, tmpl, fill))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(c[keep]) for c in cols), *lists], names=names)

    return src.mapInArrow(run, f"key {t['key']}, page {t['page']}, {FIELDS}")


def unfilled(lines: DataFrame, fills: int = FILLS) -> DataFrame:
    """(tmpl, fill) of the lines that are unfilled slots, by alignment with all other lines.

    A placeholder is one unless its line explains it: where another word of the line varies, it hardly does; or it never
    varies in a long line. A name or blank is one if at least `fills` other lines differ from it in that place alone.
    """
    s = lines.where("strong").groupBy("tmpl", "fill").agg(F.min("page").alias("a"), F.max("page").alias("b"), F.max("weight").alias("weight"), F.first("wild").alias("wild"))
    s = cut(s)
    # captures of one page may differ by damage: what varies must do so over pages
    each = s.groupBy("tmpl").agg(F.count("*").alias("fills"), F.min("a").alias("p0"), F.max("b").alias("p1")).select("tmpl", ((F.col("fills") > 1) & (F.col("p0") != F.col("p1"))).alias("varies"))
    # with one word masked: on how many pages, and on how many with the most frequent fill
    w = s.select("tmpl", "fill", F.col("a").alias("page"), F.explode("wild").alias("w"))
    same = w.select("w", "fill", "page").distinct().groupBy("w", "fill").agg(F.count("*").alias("k")).groupBy("w").agg(F.sum("k").alias("n"), F.max("k").alias("most"))
    same = same.where((F.col("most") >= EXPLAINED) & (F.col("most") >= SAME * F.col("n"))).select("w")
    explained = w.join(same, "w", "left_semi").select("tmpl").distinct().withColumn("explains", F.lit(True))
    x = s.join(each, "tmpl").join(explained, "tmpl", "left")
    strong = x.where(F.col("explains").isNull() & (F.coalesce("varies", F.lit(False)) | (F.col("weight") < CONTENT_LETTERS))).select("tmpl", "fill")
    # names and blanks: what else stands in their place
    weak = cut(lines.where("weak").select("tmpl", "fill").distinct())
    probe = lines.where(F.size("probes") > 0).select("h", F.explode("probes").alias("tmpl"))
    there = probe.join(weak.select("tmpl").distinct(), "tmpl", "left_semi").select("tmpl", F.col("h").alias("fill")).union(weak).union(s.select("tmpl", "fill")).distinct()
    many = there.groupBy("tmpl").agg(F.count("*").alias("n")).where(F.col("n") > fills).select("tmpl")
    return strong.union(weak.join(many, "tmpl", "left_semi")).distinct()


def page_messages(pages: DataFrame, content: DataFrame) -> DataFrame:
    """h of the lines that stand mostly on pages without content, on several hosts or on whole pages that recur."""
    own = pages.where("not strong and not weak")
    whole = own.groupBy("key", "page", "host").agg(F.sum(F.pmod("h", F.lit(1 << 40))).alias("all")).join(content, "key", "left_anti")
    twice = whole.groupBy("host", "all").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a <> b").select("host", "all")
    copies = whole.join(twice, ["host", "all"], "left_semi").select("key", F.lit(True).alias("copy"))
    seen = own.join(content.withColumn("has", F.lit(True)), "key", "left").join(copies, "key", "left")
    # a page shows content if one of its captures does
    per = seen.groupBy("h", "page").agg(F.max(F.coalesce("has", F.lit(False))).alias("has"), F.max(F.coalesce("copy", F.lit(False))).alias("copy"), F.min("host").alias("host"))
    bare = lambda c: F.when(~F.col("has"), F.col(c))
    n = per.groupBy("h").agg(F.count("*").alias("n"), F.count_if(~F.col("has")).alias("bare"), F.min(bare("host")).alias("a"), F.max(bare("host")).alias("b"), F.max(bare("copy")).alias("copy"))
    return n.where((F.col("bare") >= MESSAGE_PAGES) & (F.col("bare") >= MESSAGE_SHARE * F.col("n")) & ((F.col("a") != F.col("b")) | F.col("copy"))).select("h")


def find_residue(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """field and row_key of whole page texts (`pages`: key, page, url, text) and blocks (`blocks`, the same) that are residue.

    A page text is residue if one of its lines is and it has no content, a sentence that is neither residue nor stands on
    RECURS pages, whatever notices stand around; a block is if all its lines are. Null and empty texts are not residue; rows
    delivered twice are reported once. Keys and pages may be of any type; the address only tells hosts apart.
    """
    a = cut(line_looks(pages, "key", "page", "url", "text"))
    b = cut(line_looks(blocks, "key", "page", "url", "text"))
    # a page's own long sentence that has a wording explains or quotes it
    often = a.unionByName(b).where("sentence and page is not null").select("h", "page").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= RECURS).select("h")
    often = cut(often).withColumn("often", F.lit(True))
    speaks = F.col("sentence") & (F.col("weight") >= SPEAKS_LETTERS) & F.col("often").isNull()
    told = lambda x: x.join(often, "h", "left").withColumn("worded", F.col("worded") & ~speaks)
    a, b = told(a), told(b)
    both = a.unionByName(b)
    slots = cut(unfilled(both)).withColumn("open", F.lit(True))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    odd = a.where("strong or weak").join(slots, ["tmpl", "fill"], "left").select("key", yes("open").alias("open"), "sentence", "weight", "often", "strong")
    # explanations of placeholders are sentences like others
    own = a.where("sentence and not strong and not weak and not worded").select("key", "often", "weight").union(odd.where("not open and (sentence or strong)").select("key", "often", "weight"))
    content = cut(own.where(F.col("often").isNull() & (F.col("weight") >= CONTENT_LETTERS)).select("key").distinct())
    induced = cut(page_messages(a, content)).withColumn("induced", F.lit(True))
    whole = odd.where("open").select("key").union(a.where("worded").select("key")).union(a.where("not strong and not weak").join(induced.select("h"), "h", "left_semi").select("key"))
    whole = whole.distinct().join(content, "key", "left_anti")
    parts = b.join(slots, ["tmpl", "fill"], "left").join(induced, "h", "left")
    bad = F.when(F.col("strong") | F.col("weak"), yes("open")).otherwise(yes("induced")) | F.col("worded")
    parts = parts.groupBy("key").agg(F.min(bad).alias("all")).where("all")
    return whole.select(F.lit("visible_text").alias("field"), F.col("key").alias("row_key")).union(parts.select(F.lit("block_text"), "key"))


def not_a_time(value: Column) -> Column:
    """The value is not null and no time in any notation."""
    return value.isNotNull() & ~value.rlike(TIME)
