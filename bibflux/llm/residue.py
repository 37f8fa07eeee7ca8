"""Template residue, filler, error pages and script notices that stand where content should be.

Each text is cut into messages: its sentences and lines without tags. Numbers, addresses, dates and placeholder names are masked, so that copies of one
message with other values get one hash. All messages of all documents are counted by that hash; those that recur widely, in ``min_docs``
documents of ``min_sources`` sources, are classified by phrase and placeholder rules, once per message however often it occurs. A message that does not
recur is content, whatever it says, and so is one that writes *about* such things.

Filler made of words in random order never recurs as a message, but its words do: the words of messages that begin with "lorem ipsum" and recur among these form the
corpus's filler vocabulary, and a message of nothing else is filler.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflux.functions.let import let
from bibflux.session import written

#: Field names that templates use; a bracketed word is a placeholder only if it is made of such names.
FIELD = r"(?:first|last|full|user|your|n|no|num)?[_ ]?(?:name|author|title|date|year|month|day|city|country|place|institution|university|department|journal|volume|course|class|topic|subject|summary|abstract|keyword|keywords|students|email|address|phone|company|organi[sz]ation|text|content|description|url|link|id|number|value|amount)s?(?:[_ ]?(?:name|\d+))?"
_NAME = r"[a-z][\w .\-]{0,40}"
#: Unfilled slots, by notation.
SLOTS = (
    rf"\{{\{{-?\s*{_NAME}\s*-?\}}\}}",
    rf"\{{%-?\s*{_NAME}\s*-?%\}}",
    rf"<%[=\-]?\s*{_NAME}\s*%>",
    rf"\$\{{\s*{_NAME}\s*\}}",
    r"(?<![\w%])%[a-z][a-z_0-9 ]{1,30}%(?!\w)",
    r"(?<!\w)__[a-z][a-z0-9_ ]{1,30}__(?!\w)",
    rf"[«<]{{1,2}}\s?{FIELD}\s?[»>]{{1,2}}",
    rf"\[\[\s*{_NAME}\s*\]\]",
    rf"\[\s*{FIELD}\s*\]",
    rf"(?<!\{{)\{{\s*{FIELD}\s*\}}(?!\}})",
    rf"(?<!\w)[@#]{FIELD}[@#](?!\w)",
    r"\[\s*(?:insert|add|enter|your|type|put|tbd|todo|inserte|insertar|insérer|inserir|einfügen)\b[^\]]{0,60}\]",
    r"\[[^\]\[]{1,60}\b(?:to be (?:added|inserted|completed|supplied|confirmed|determined)|goes here|here)\s*\]",
)
SLOT = "(?:" + "|".join(SLOTS) + ")"

#: Phrases of fillers, errors and notices; matched anywhere in a message that recurs.
PHRASES = {
    "filler": (
        r"\blorem ipsum\b",
        r"(?:\bblah\b[ ,.]*){2}",
        r"(?:\basdf\b\W{0,9}){2}",
        r"(?:\bqwer(?:ty)?\b\W{0,9}){2}",
        r"(?:\btest\b \d*\W{0,9}){2}",
        r"(?:\btext\b\W{0,9}){3}",
        r"\bfoo bar\b",
        r"\bx{4,}\W+x{3,}\b",
        r"\bdummy (?:text|paragraph|content|copy)\b",
        r"\b(?:this is|replace this) (?:some |a )?(?:sample|example|dummy|placeholder|filler|default) (?:text|paragraph|content|copy)\b",
        r"\b(?:stand-in|placeholder) until the real\b",
        r"\breplace (?:it|this)(?: \w+)? with your own\b",
        r"\binsert (?:body copy|text|title|content|your \w+|abstract)\b(?: here)?",
        r"\b(?:type|enter|write|paste|put|add) your \w+(?: \w+)? here\b",
        r"\byour (?:summary|abstract|text|title|content|name) (?:goes )?here\b|\byour \w+ goes here\b",
        r"\b(?:todo|tbd|fixme)\b:? (?:write|add|complete|fill|insert|describe|this)\b",
        r"\b(?:content|abstract|text|page|summary) (?:is )?(?:coming soon|to follow)\b",
        r"\babstract to be (?:supplied|added|provided|completed|inserted)\b",
        r"-\s?no content\s?-",
        r"\btexto de (?:ejemplo|relleno|prueba|exemplo|preenchimento)\b",
        r"\btexte (?:provisoire|d'exemple|de remplissage)\b",
        r"\bhier steht (?:der|ihr|ein) \w*text\b|\b(?:beispieltext|platzhaltertext|blindtext|mustertext)\b",
        r"\b(?:aquí|aqui) (?:va|vai|entra) (?:el|o|su|seu) (?:resumen|resumo|texto|título)\b",
        r"\b(?:insira|inserir|escreva|digite) (?:aqui )?(?:o|seu) (?:resumo|texto|título)\b|\b(?:escriba|inserte|introduzca) (?:aquí )?(?:el|su) (?:resumen|texto|título)\b",
        r"\b(?:saisissez|insérez|votre) (?:ici )?(?:le |votre )?(?:résumé|texte|titre)(?: ici)\b",
        r"\b(?:ihr|der) (?:text|titel|abstract) (?:steht )?hier\b",
    ),
    "error": (
        r"\bhttp \d{3}\b ?:",
        r"\b(?:error|erreur|fehler|erro) \d{3}\b ?[:.]",
        r"\bnot available \(\d{3}\)|\bbad gateway\b|\binternal server error\b|\bservice (?:temporarily )?unavailable\b",
        r"\bobject moved\b|\bpage has moved\b|\bno forwarding address\b",
        r"\b(?:record|page|document|item|article) (?:you (?:asked for|requested|are looking for) )?(?:could not|cannot|can't|couldn't) be (?:found|displayed|loaded|opened)\b",
        r"\b(?:could not|couldn't|cannot|can't) (?:display|load|open|find) (?:this|the) (?:item|page|article|document|record|abstract)\b",
        r"\brequest could not be completed\b|\btoo many requests\b",
        r"\bserver did not (?:answer|respond)\b|\bconnection (?:timed out|refused|reset)\b",
        r"\bsession has (?:timed out|expired)\b|\bsign in again\b|\breload the page\b",
        r"\bsomething went wrong\b",
        r"\b(?:down|closed|unavailable) for maintenance\b",
        r"\baccess to (?:this|the) \w+(?: \w+)? is (?:denied|forbidden|restricted)\b|\baccess denied (?:for|to)\b|\bpermission denied\b",
        r"\btraceback \(most recent call last\)|\buncaught \w*error\b|\b\w+(?:\.\w+)*exception at\b|\bfatal error:|\bwarning: \w+\(\)|\bsqlstate\b|\bquery failed:|\bundefined (?:index|variable|offset)\b|\bsyntax error (?:near|at)\b|\bstack trace:",
        r"\bpágina (?:solicitada )?(?:no existe|não (?:foi )?encontrada|no encontrada)\b|\bpage (?:introuvable|non trouvée)\b|\bseite (?:wurde )?nicht gefunden\b",
        r"\b(?:su sesión ha (?:caducado|expirado)|sua sessão (?:expirou|caducou)|ihre sitzung ist abgelaufen|votre session a expiré)\b",
        r"\b(?:acceso denegado|acesso negado|accès refusé|zugriff verweigert)\b",
        r"\b(?:no fue posible|não foi possível|impossible de) (?:cargar|carregar|mostrar|exibir|charger|afficher)\b",
        r"\b(?:intente|tente) (?:de nuevo |novamente )?más tarde\b|\btente (?:novamente )?mais tarde\b|\bréessayez plus tard\b",
        r"\b(?:o serviço está|el servicio (?:está|no está)|le service est|der dienst ist) (?:\w+ )?(?:indisponível|indisponible|disponible|momentanément|vorübergehend|temporalmente)\b",
        r"\bthe repository is down\b",
        r"^\W*(?:please )?(?:try again later|wait|loading)\b|\b(?:page )?not found\W*$|^\W*access denied\b|\bloading(?:\.{3}|…)|\bcargando(?:\.{3}|…)|\boops\b|\berror\b[^.]{0,20} 0\b|\bdisabled in your browser\b|\bunavailable\b",
    ),
    "script": (
        r"\b(?:enable|activate|turn on|switch on|allow) (?:java ?script|scripts?|scripting|cookies)\b[^.]{0,40}\b(?:to|for|in) (?:read|view|use|continue|see|display|access|this|your)\b",
        r"\bwithout java ?script\b",
        r"\bturn on (?:cookies|java ?script|scripting)\b",
        r"\b(?:scripts?|java ?script|cookies) (?:to be|must be|need to be|should be) (?:switched on|enabled|turned on|allowed)\b",
        r"\b(?:scripting|java ?script|cookies) (?:is|are) (?:disabled|turned off|switched off|required|blocked|not enabled)\b",
        r"\byour browser (?:does not|doesn't|must|is not|isn't|needs)\b",
        r"\bchecking (?:that|if) you are (?:a )?human\b|\bchecking your browser\b|\bverify (?:that )?you are (?:a )?human\b",
        r"\bnothing appears, allow scripts\b",
        r"\b(?:active|ative|activez|habilite|active usted) (?:o |el |le |los )?(?:java ?script|scripts|cookies)\b|\bveuillez activer\b|\bbitte aktivieren sie\b",
        r"\b(?:navegador|navigateur) (?:debe|deve|doit|no admite|não suporta|ne prend pas)\b|\bihr browser\b",
        r"\b(?:precisa de|requiere|requiert|benötigt|necesita)\b[^.]{0,30}\b(?:scripts?|skripte|cookies|java ?script)\b",
        r"\b(?:scripts?|java ?script|cookies) (?:habilitados|activados|ativados|activés|désactivés|deaktiviert|desactivados)\b",
        r"\bhabilite los scripts\b",
    ),
}
#: Words of sentences that write about placeholders, errors and scripts.
ABOUT_SLOT = r"\b(?:tags?|annotators?|variables?|examples?|template|written as|placeholders?|called|stored as|notation|syntax)\b"
ABOUT = r"\b(?:students?|pupils?|novices?|learn(?:s|ers?)?|teach(?:es|ers?|ing)?|courses?|unit|exercises?|examples?|annotators?|reviewers?|called|such as|paragraphs and|were (?:first )?tested|explained|when we|we checked|cited|is raised|returned an?|how to|participants|interviews?)\b"
_BLOCK = r"</?(?:p|br|hr|div|li|ul|ol|td|th|tr|table|h[1-6]|html|body|head|section|article|header|footer|nav|form|script|style)\b[^<>]*>|</title>|<title>(?=[^<>]{0,300}</title>)"
_INLINE = rf"(?<!<)(?!<{FIELD}>)</?[a-z][a-z0-9]*(?:\s[^<>]{{0,300}})?/?>(?!>)"


def messages(text: Column) -> Column:
    """The sentences and lines of a text without tags, with single spaces; a long line that ends within a sentence goes on in the next."""
    plain = F.when(F.contains(text, F.lit("<")), F.regexp_replace(F.regexp_replace(text, rf"(?i){_BLOCK}", "\n"), rf"(?i){_INLINE}", " ")).otherwise(text)
    broken = F.contains(plain, F.lit("\n"))
    lines = F.when(~broken, plain).otherwise(F.regexp_replace(plain, r"\n(?<=[^\n]{30}[\p{Ll},][ \t]{0,4}\r?\n)[ \t]*(?=\p{Ll})", " "))
    return F.split(lines, r"\s*[\r\n]\s*|(?<=[.!?…])\s+")


def masked(message: Column) -> Column:
    """Lower case with single spaces; numbers, addresses, dates, codes and slot names replaced by one sign each, a repeated phrase said three times."""

    def step(m: Column, needs: str, pattern: str, sign: str) -> Column:
        return let(m, lambda x: F.when(x.rlike(needs), F.regexp_replace(x, pattern, sign)).otherwise(x))

    m = F.trim(F.regexp_replace(F.lower(message), r"[\s\x{a0}\x{ad}\x{200b}]+", " "))
    m = step(m, r"[@/]|www\.", r"\b(?:https?://|www\.)\S+|\b[\w.+-]+@[\w-]+\.[\w.]+", "⟨address⟩")
    m = step(m, r"[{<%$«\[@#]|__", SLOT, "⟨slot⟩")
    m = step(m, r"\d", r"\b[0-9a-f]*\d[0-9a-f]{5,}\b|\d+(?:[.,/:-]\d+)*", "0")
    return let(m, _said_once)


def _said_once(m: Column) -> Column:
    """A message that says one thing over and over says it three times; no pattern runs along the whole message, which may be very long."""
    unit = F.regexp_extract(m, r"^(.{2,40}?) ?\1(?: ?\1|[ .!?…]*$)", 1)

    def checked(s: Column) -> Column:
        whole = s["x"] == F.repeat(s["y"], F.floor(F.length(s["x"]) / F.greatest(F.length(s["y"]), F.lit(1))).cast("int"))
        return F.when(whole, F.concat_ws(" ", s["u"], s["u"], s["u"])).otherwise(m)

    bare = lambda c: F.regexp_replace(c, "[ .!?…]", "")
    return let(unit, lambda u: F.when(u == "", m).otherwise(let(F.struct(F.trim(u).alias("u"), bare(m).alias("x"), bare(u).alias("y")), checked)))


def _any(*patterns: str) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def classified(messages_: DataFrame) -> DataFrame:
    """Adds ``kind`` to ``(message)``: placeholder, filler, error, script, or null for content."""
    m = F.col("message")
    about = m.rlike(ABOUT)
    kind = F.when(F.contains(m, F.lit("⟨slot⟩")) & ~m.rlike(ABOUT_SLOT), "placeholder")
    for name, patterns in PHRASES.items():
        kind = kind.when(m.rlike(_any(*patterns)) & ~about, name)
    return messages_.withColumn("kind", kind)


def _widely(rows: DataFrame, by: str, min_docs: int, min_sources: int) -> DataFrame:
    """``(by)`` of what occurs in enough documents and sources; ``rows(by, _source)`` has one row per document."""
    counted = rows.groupBy(by, "_source").agg(F.count(F.lit(1)).alias("_n")) if min_sources > 2 else rows.select(by, "_source", F.lit(1).alias("_n"))
    sources = F.count(F.lit(1)) if min_sources > 2 else F.when(F.min("_source") == F.max("_source"), 1).otherwise(2)
    return counted.groupBy(by).agg(F.sum("_n").alias("_docs"), sources.alias("_sources")).filter((F.col("_docs") >= min_docs) & (F.col("_sources") >= min_sources)).select(by)


def find_residue(df: DataFrame, key: str, text: str, source: str, min_docs: int = 3, min_sources: int = 2) -> DataFrame:
    """Rows ``(key, kind, n_messages)`` for every document with residue, one per kind found in it.

    ``df`` has a unique ``key``; rows whose text is null or empty give no row; a null ``source`` counts as one source of
    its own. ``n_messages`` counts different messages. Other columns are ignored; an empty table gives an empty result.
    """
    own = F.array_distinct(F.filter(F.transform(messages(F.col(f"`{text}`")), masked), lambda m: m != ""))
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.xxhash64(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))).alias("_source"), F.explode(own).alias("message"))
    rows = written(rows.withColumn("_hash", F.xxhash64("message")))
    # only hashes are counted; of the messages that recur one text each is classified
    seen = rows.select("_hash", "message").join(_widely(rows, "_hash", min_docs, min_sources), "_hash")
    bad = written(classified(seen.groupBy("_hash").agg(F.min("message").alias("message"))).filter(F.col("kind").isNotNull()).select("_hash", "kind"))
    recurring = rows.select("_key", "_hash").join(bad, "_hash").select("_key", "kind", "_hash")
    words = lambda m: F.filter(F.split(m, r"\P{L}+"), lambda w: w != "")
    seeds = rows.filter(F.startswith("message", F.lit("lorem ipsum"))).select("_key", "_source", F.explode(F.array_distinct(words(F.col("message")))).alias("_w")).distinct()
    filler = written(_widely(seeds.select("_w", "_source"), "_w", min_docs, min_sources))
    # a message of five words or more that are all filler: the first of them is, and then each of its different words finds itself there
    found = words(F.col("message"))
    parts = rows.select("_hash", found.alias("_all"), F.get(found, F.lit(0)).alias("_w")).filter(F.size("_all") >= 5).join(filler, "_w", "left_semi")
    parts = parts.select("_hash", F.array_distinct("_all").alias("_ws")).select("_hash", F.size("_ws").alias("_n"), F.explode("_ws").alias("_w")).join(filler, "_w")
    random = parts.distinct().groupBy("_hash", "_n").agg(F.count(F.lit(1)).alias("_found")).filter("_found = _n").select("_hash")
    scrambled = rows.select("_key", "_hash").join(random, "_hash").join(bad.select("_hash"), "_hash", "left_anti").select("_key", F.lit("filler").alias("kind"), "_hash")
    return recurring.unionByName(scrambled).groupBy(F.col("_key").alias(key), "kind").agg(F.count(F.lit(1)).alias("n_messages"))
