"""Operator 10: personal data replaced by keyed, type-consistent surrogates."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from contextlib import suppress
from ipaddress import ip_address

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import map_batches, saved, table, texts_of

#: Titles that a personal name follows, with the gender that they tell (f, m or n).
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Dr": "n", "Prof": "n", "Professor": "n",
    "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f",
    "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
#: Syllables of made-up names, and their endings by gender, for each script.
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe ga go ha ja ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va vi".split(), {"f": ["lia", "na", "ra", "sa"], "m": ["rd", "lf", "ton", "rik"], "n": ["len", "ris", "man", "ber"]}),
    "cyrillic": ("ба бе би бо ва ве ви го да де ди до ка ки ла ле ли ло ма ми мо на не ни но ра ре ри ро са се та те ти то".split(), {"f": ["на", "ра", "ва", "ля"], "m": ["слав", "мир", "дан", "тин"], "n": ["ко", "ник", "рих", "сон"]}),
    "greek": ("βα βε γα δα δε κα κε λα λε λι λο μα με μι να νε νι πα πε ρα ρε ρο σα σε τα τε τι το".split(), {"f": ["να", "ρα", "λια", "τη"], "m": ["ρος", "νος", "λης", "τας"], "n": ["δης", "κος", "ρης", "λος"]}),
}

#: Whatever stands before a keyword (db_password, clientSecret) belongs to its name, as does a key behind it (secret_access_key).
_KEYWORDS = "(?:token|password|passwd|pwd|secret|api[_-]?key)(?:[_-]?(?:access[_-]?)?key)?"
#: A text with an entity but without digits, an at sign or a title holds one of these in small letters.
_PLAIN_KEYWORDS = ("token", "passw", "pwd", "secret", "api", "akia", "asia", "authorization", "private key-----")
#: Entities by their form. A look at the first character spares most places the alternatives.
_ENTITY = re.compile(
    rf"""(?=[tpsa-])(?:(?:{_KEYWORDS}["']?\s{{0,3}}[:=]\s{{0,3}}(?:"(?P<secret2>[^"\r\n]+)"|'(?P<secret1>[^'\r\n]+)'|["']?(?P<secret>\S+)))"""
    r"""|(?:authorization["']?\s{0,3}[:=]\s{0,3}["']?(?:bearer|basic|token)\s{1,3}(?P<header>[^\s"']+))"""
    r"""|(?:-----begin\ (?:[a-z]+\ ){0,3}private\ key-----(?P<pem>[^-]+)-----end)"""
    r"""|(?P<access>(?<![a-z0-9])(?:akia|asia)[a-z0-9]{16}(?![a-z0-9])))"""
    r"""|(?P<email>(?<![\w.%+-])[\w.%+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8})"""
    r"""|(?P<iban>(?<!\w)[a-z]{2}[0-9]{2}(?:\ ?[a-z0-9]{4}){2,7}(?:\ ?[a-z0-9]{1,3})?(?!\w))"""
    r"""|(?=[0-9+(])(?:(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))"""
    r"""|(?P<phone>(?<![0-9+])\+[0-9]{1,3}[\ .-]?\(?[0-9]{2,4}\)?(?:[\ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\([0-9]{3}\)\ ?[0-9]{3}[-.\ ][0-9]{4}(?![0-9])|(?<![0-9])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9]))"""
    r"""|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"""
    r"""|(?P<card>(?<![0-9])(?:[0-9]{4}[\ -]){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])))""",
    re.I,
)
#: Addresses of eight groups, or with a double colon; what they hold is tested by ``ipaddress``.
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9a-f]{1,4}:){1,7}(?::?[0-9a-f]{1,4}){1,7}(?![\w:]|\.[0-9])|(?<![\w:.])::(?:[0-9a-f]{1,4}:){0,6}[0-9a-f]{1,4}(?![\w:]|\.[0-9])", re.I)
#: Words; an English possessive ending isn't part of one.
_WORD = re.compile(r"\w+(?:(?!['’]s\b)[-'’]\w+)*")
_NAME = re.compile(r"(?<!\w)(" + "|".join(TITLES) + r")\.?(?=((?:[ ]\w+(?:[-'’]\w+)*){1,3}))")
_DIGITS = re.compile(r"[0-9]")
#: What stands before a parameter's name in an address, whose value ends at the next one.
_IN_URL = re.compile(r"[?&][\w.-]*$")
#: Words that begin with a capital in headlines, and aren't names behind a title.
_NO_NAMES = frozenset("the and of in is was are were has had said but or if it this that who which with for from at by on to not und ist war hat mit et est sont avec dans y es son con".split())
#: Marks behind an unquoted credential that aren't replaced with it.
_TRAILING = ".,;:!?)]}>\"'`"
#: Letters and digits that a credential's surrogate has at least, so that short ones stay distinct.
LEAST_SECRET = 8
#: Attempts that keep the length of an entity, where short ones may run out, and that keep
#: a number's format and take no real entity of the corpus.
SAME_LENGTH, SAME_FORMAT = 4, 16
#: Entities above this share of all mentions, fewer than its inverse, reach their mentions by a broadcast.
HOT_SHARE = 0.001


def _script(word: str) -> str | None:
    if word[0] < "\x80":
        return "latin" if word[0].isalpha() else None
    name = unicodedata.name(word[0], "")
    return next((s for s in SYLLABLES if name.startswith(s.upper())), None)


def _iban_rest(text: str) -> int:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def suspect(text: str) -> bool:
    """Could the text hold an entity? Substring tests only; never wrong where false."""
    if any(map(text.__contains__, "1203456789@")) or any(map(text.__contains__, TITLES)):
        return True
    low = text.lower()
    if not low.isascii():  # letters that count as s or i where case is ignored
        low = low.replace("\u017f", "s").replace("\u0131", "i").replace("\u0307", "")
    return any(map(low.__contains__, _PLAIN_KEYWORDS))


def _marked(text: str) -> Iterator[tuple[int, int, str, str, str, str]]:
    """Entities that their own form tells."""
    for m in _ENTITY.finditer(text):
        kind = m.lastgroup
        start, end = m.span(kind)
        own = text[start:end]
        if kind in ("secret", "secret1", "secret2", "access", "header", "pem"):
            if kind == "secret" and _IN_URL.search(text, max(0, m.start() - 64), m.start()):
                own = re.split("[&#]", own, maxsplit=1)[0]
            if kind in ("secret", "header"):
                own = own.rstrip(_TRAILING)
                end = start + len(own)
            if kind == "secret" and ":" in text[m.start() : start] and own.isalpha() and len(own) < LEAST_SECRET:
                continue  # a word of running text
            kind = "secret"
            if not any(c.isalnum() for c in own):
                continue
        elif kind == "email":
            local, _, domain = own.lower().partition("@")
            at = start + own.index("@")
            yield start, at, "mailbox", local, domain, ""
            yield at + 1, end, "domain", domain, "", ""
            continue
        elif kind == "iban":
            own = own.replace(" ", "")
            if not own.isascii() or _iban_rest(own) != 1:
                continue
        elif kind == "ip":
            if any(int(x) > 255 for x in own.split(".")):
                continue
        elif kind in ("phone", "ssn", "card"):
            own = "".join(_DIGITS.findall(own))
            if (kind == "phone" and not 7 <= len(own) <= 15) or (kind == "card" and _luhn(own) != 0):
                continue  # book numbers and time stamps have as many digits
        yield start, end, kind, own.lower(), "", ""
    for m in _IP6.finditer(text) if "::" in text or text.count(":") > 6 else ():
        if _DIGITS.search(m[0]):
            with suppress(ValueError):
                yield *m.span(), "ip6", ip_address(m[0]).compressed, "", ""


def _named(text: str) -> Iterator[tuple[int, int, str, str, str, str]]:
    """Up to three capitalised words behind a title; and the same words wherever else they
    stand in the text, unless it also has them in small letters."""
    titled: dict[str, str] = {}
    at: set[int] = set()
    for m in _NAME.finditer(text):
        words = []
        for w in _WORD.finditer(text, m.start(2), m.end(2)):
            if w[0] in TITLES or w[0].lower() in _NO_NAMES or not (w[0][0].isupper() and (script := _script(w[0]))):
                break
            words.append((*w.span(), "name", w[0].lower(), script))
        for k, word in enumerate(words):
            titled[word[3]] = word[4]
            at.add(word[0])
            yield *word, TITLES[m[1]] if k == 0 and len(words) > 1 else ""
    if titled:
        words = [w for w in _WORD.finditer(text) if w[0].lower() in titled]
        common = {w[0] for w in words if w[0].islower()}
        for w in words:
            if w.start() not in at and w[0][0].isupper() and w[0].lower() not in common:
                yield *w.span(), "name", w[0].lower(), titled[w[0].lower()], ""


def mentions(text: str) -> Iterator[tuple[int, int, str, str, str, str]]:
    """(start, end, kind, canonical form, scope, gender) of each entity, in order, not
    overlapping. Mentions that differ in case or separators only have one canonical
    form. The scope is a mailbox's domain or a name's script; within it surrogates differ.
    """
    if not text or not suspect(text):
        return
    last = 0
    for one in sorted([*_marked(text), *_named(text)]):
        if one[0] >= last:
            last = one[1]
            yield one


class _Stream:
    """Endless keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.key, self.seed, self.turn, self.left = key, f"{kind}\0{canon}\0{attempt}".encode("utf-8", "surrogatepass"), 0, 0
        self.value = 0

    def below(self, n: int) -> int:
        if self.left < 24:
            self.value = int.from_bytes(hmac.digest(self.key, self.seed + self.turn.to_bytes(4, "big"), "sha256"), "big")
            self.turn, self.left = self.turn + 1, 256
        self.value, out = divmod(self.value, n)
        self.left -= n.bit_length()
        return out


_SMALL = "abcdefghijklmnopqrstuvwxyz"
_HEX = "0123456789abcdef"
_ALPHABETS = {script: "".join(sorted({c for part in parts for c in part})) for script, (parts, _) in SYLLABLES.items()}


def _like(own: str, stream: _Stream) -> str:
    """The same pattern of digits and of letters of the same script."""
    out = []
    for c in own:
        if c in _SMALL:
            out.append(_SMALL[stream.below(26)])
        elif c.isalpha():
            alphabet = _ALPHABETS.get(_script(c), _SMALL)
            out.append(alphabet[stream.below(len(alphabet))])
        else:
            out.append(str(stream.below(10)) if c.isalnum() else c)
    return "".join(out)


def _picked(alphabet: str, n: int, stream: _Stream) -> str:
    return "".join(alphabet[stream.below(len(alphabet))] for _ in range(n))


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _ip_core(canon: str, attempt: int, stream: _Stream) -> str:
    """An address as private as the original. Where these run out, any address, then
    one of the other family."""
    own = []
    if attempt < SAME_FORMAT:
        first = canon.split(".")[0]
        own = ["10"] if first == "10" else ["127"] if first == "127" else ["192", "168"] if canon.startswith("192.168.") else []
        if own == ["192", "168"] and attempt >= SAME_LENGTH:
            own = ["10"]
    elif attempt >= 2 * SAME_FORMAT:
        return _ip6_core("", stream)
    while len(own) < 4:
        own.append(str(1 + stream.below(223 if not own else 254)))
    return ".".join(own)


def _ip6_core(canon: str, stream: _Stream) -> str:
    """Link-local and unique-local addresses stay such; others lie in the range for documentation."""
    head = canon.split(":")[0]
    first = ["fe80", "0", "0", "0"] if head == "fe80" else ["fd" + _picked(_HEX, 2, stream), _picked(_HEX, 4, stream)] if head[:2] in ("fc", "fd") and len(head) == 4 else ["2001", "db8"]
    return ip_address(":".join(first + [_picked(_HEX, 4, stream) for _ in range(8 - len(first))])).compressed


def core_of(kind: str, canon: str, scope: str, gender: str, attempt: int, key: bytes) -> str:
    """The surrogate of a canonical form: as long as it for all kinds but names and
    addresses of machines, with the same check digits, country and top-level domain. Later
    attempts are longer, so that no kind of entity can run out of surrogates."""
    stream = _Stream(key, f"{kind}\0{scope}", canon, attempt)
    longer, more = max(0, attempt - SAME_LENGTH + 1), max(0, attempt - SAME_FORMAT + 1)
    if kind == "mailbox":
        return _like(canon, stream) + _picked(_SMALL, longer, stream)
    if kind == "domain":
        head, dot, top = canon.rpartition(".")
        return _like(head, stream) + _picked(_SMALL, longer, stream) + dot + top
    if kind == "secret":
        if canon[:4] in ("akia", "asia") and len(canon) == 20:
            return canon[:4] + _picked("abcdefghijklmnopqrstuvwxyz234567", 16 + more, stream)
        own = _picked(_HEX, len(canon), stream) if set(canon) <= set(_HEX) else _like(canon, stream)
        return own + _picked(_HEX, max(0, LEAST_SECRET - sum(c.isalnum() for c in canon)) + more, stream)
    if kind == "ip":
        return _ip_core(canon, attempt, stream)
    if kind == "ip6":
        return _ip6_core(canon, stream)
    if kind == "iban":
        body = _like(canon[4:], stream) + _picked("0123456789", more, stream)
        check = 98 - int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return f"{canon[:2]}{check:02d}{body}"
    if kind in ("phone", "ssn", "card"):
        keep = max(0, len(canon) - 10) if kind == "phone" else 0  # the country's number
        own = canon[:keep] + _picked("0123456789", len(canon) - keep + more, stream)
        if kind == "card" and _luhn(canon) == 0:
            own = own[:-1] + str((-_luhn(own[:-1] + "0")) % 10)
        return own
    syllables, endings = SYLLABLES[scope]
    middle = "".join(syllables[stream.below(len(syllables))] for _ in range(2 + attempt // 2))
    return middle + endings[gender][stream.below(len(endings[gender]))]


def rendered(mention: str, kind: str, core: str) -> str:
    """The surrogate in the mention's own format: separators and case."""
    if kind in ("phone", "ssn", "card", "iban"):
        own = iter(core)
        out = "".join(next(own) if c.isalnum() else c for c in mention)
        out = "".join(o.upper() if c.isupper() else o for o, c in zip(out, mention)) if kind == "iban" else out
        return out + "".join(own)
    if kind in ("mailbox", "domain", "secret", "ip6"):
        if mention.isupper():
            return core.upper()
        return core if kind == "ip6" else "".join(o.upper() if c.isupper() else o for o, c in zip(core, mention)) + core[len(mention) :]
    if kind == "ip":
        return core
    return core.upper() if len(mention) > 1 and mention.isupper() else core[:1].upper() + core[1:]


ENTITY = ["kind", "scope", "canon"]


def assign(entities: DataFrame, key: bytes, *, attempts: int = 64) -> DataFrame:
    """kind, scope, canon, core for each distinct entity (columns kind, scope, canon, gender).

    Every attempt proposes cores for the entities that have none. A proposal is
    taken if no other entity of the kind and scope proposed or has it (of several, the least
    canonical form takes it) and, for the first ``SAME_FORMAT`` attempts, if it is no real
    entity of the corpus. All checks are joins and aggregates on (kind, scope, core); an
    entity is one row, however often it is mentioned. Later attempts propose longer cores.
    """
    schema = "kind string, scope string, canon string, core string"
    real = entities.select("kind", "scope", F.col("canon").alias("core"))
    pending, taken = entities, None
    for attempt in range(attempts):

        def step(batch: pa.RecordBatch, attempt=attempt) -> pa.RecordBatch:
            kinds, scopes, canons, genders = (c.to_pylist() for c in batch.columns)
            cores = [core_of(k, c, s, g, attempt, key) for k, s, c, g in zip(kinds, scopes, canons, genders)]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cores, pa.string())], [*ENTITY, "core"])

        proposed = map_batches(pending.select(*ENTITY, "gender"), step, schema)
        one = proposed.groupBy("kind", "scope", "core").agg(F.min("canon").alias("canon"))
        if attempt < SAME_FORMAT:
            one = one.join(real, ["kind", "scope", "core"], "left_anti")
        if taken is not None:
            one = one.join(taken, ["kind", "scope", "core"], "left_anti")
        accepted = saved(one.select(*ENTITY, "core"), "accepted")
        taken = accepted if taken is None else taken.unionByName(accepted)
        pending = saved(pending.join(accepted, ENTITY, "left_anti").select(*ENTITY, "gender"), "pending")
        if pending.isEmpty():
            return taken
    raise ValueError("too few surrogates for a kind of entity")


_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), *((name, pa.string()) for name in (*ENTITY, "gender"))]))


def detected(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table of row (its number), doc_id, text and found (its mentions) for each
    row: the only pass over all texts, from which clean ones are returned as they are."""

    def detect(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [
            [{"start": a, "end": b, "kind": kind, "scope": scope, "canon": canon, "gender": gender} for a, b, kind, canon, scope, gender in mentions(text)]
            for text in batch.column(2).to_pylist()
        ]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _FOUND)], ["row", "doc_id", "text", "found"])

    rows = texts_of(df, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    fields = "start: int, end: int, kind: string, scope: string, canon: string, gender: string"
    return saved(map_batches(rows, detect, f"row long, doc_id long, text string, found array<struct<{fields}>>"), "detected")


def replace_personal(df: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, text (with surrogates), changed, n_entities,
    kinds.

    The same entity gets the same surrogate in all documents, different ones
    different surrogates, and the key decides which. Detected: mail addresses, IP
    addresses of both families, phone, card, social-security and bank account numbers,
    credentials (the whole quoted or unbroken value behind a keyword or in an authorization
    header, private keys, access keys), names behind a
    title and their bare repetitions in the same text. A name's gender is settled once for
    all documents: that of its titles, neutral if they differ.

    A single pass over all texts detects and writes; clean texts are read from there. Mentions
    of the most frequent entities, fewer than 1 / ``HOT_SHARE``, get their surrogates from a
    broadcast, the others by a join; a text's surrogates come by the number of
    its row. So neither a frequent entity nor a frequent text is one task's.

    Null texts count as empty and hold nothing. Null ids stay null; repeated rows
    give repeated results; other columns are ignored; an empty table gives an empty result.
    """
    rows = detected(df, id_col=id_col, text_col=text_col)
    dirty = rows.where(F.size("found") > 0)
    each = dirty.select("row", F.explode("found").alias("m")).select("row", *(f"m.{name}" for name in (*ENTITY, "gender")))
    has = lambda g: F.max(F.when(F.col("gender") == g, 1).otherwise(0))
    settled = F.when(has("f") > has("m"), "f").when(has("m") > has("f"), "m").otherwise("n")
    entities = saved(each.groupBy(*ENTITY).agg(settled.alias("gender"), F.count(F.lit(1)).alias("n")), "entities")
    hot = F.col("n") > HOT_SHARE * (entities.agg(F.sum("n")).first()[0] or 0)
    cores = assign(entities.drop("n"), key)
    frequent = saved(cores.join(entities.where(hot).select(*ENTITY), ENTITY), "frequent")
    own = F.array_distinct(F.transform("found", lambda m: F.struct(*(m[name].alias(name) for name in ENTITY))))
    mine = dirty.select("row", F.explode(own).alias("m")).select("row", "m.*").join(F.broadcast(frequent), ENTITY, "left")
    rare = mine.where("core is null").drop("core").join(cores, ENTITY)
    named = mine.where("core is not null").unionByName(rare)
    by_row = named.groupBy("row").agg(F.collect_list(F.struct(*ENTITY, "core")).alias("own"))  # one text's entities

    def rewrite(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts, kinds = [], [], []
        for text, found, own in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            cores = {(x["kind"], x["scope"], x["canon"]): x["core"] for x in own}
            out, at = [], 0
            for m in found:
                out += [text[at : m["start"]], rendered(text[m["start"] : m["end"]], m["kind"], cores[m["kind"], m["scope"], m["canon"]])]
                at = m["end"]
            texts.append("".join([*out, text[at:]]))
            counts.append(len(found))
            kinds.append(" ".join(sorted({m["kind"] for m in found})))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array([True] * len(texts), pa.bool_()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())],
            ["doc_id", "text", "changed", "n_entities", "kinds"],
        )

    schema = "doc_id long, text string, changed boolean, n_entities long, kinds string"
    changed = map_batches(dirty.join(by_row, "row").select("doc_id", "text", "found", "own"), rewrite, schema)
    clean = rows.where(F.size("found") == 0).select("doc_id", "text", F.lit(False).alias("changed"), F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    return clean.unionByName(changed)


#: Key of the query; who runs the operator passes their own.
QUERY_KEY = hashlib.sha256(b"countloom op10").digest()


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal(table(spark, sf_dir, "documents"), QUERY_KEY)
