"""Variant spellings of names typed by people (problem 5).

A name becomes a key: for a person the family name in one alphabet and the
given name, resolved by a table of given names, or an initial; for an
organisation its place name and the beginnings of its other words, and all its
words in alphabetical order. Keys are blocked on suffixes of the family or place
name, read in both directions so that a typo anywhere leaves one half whole,
short ones on themselves with one letter left out. Overly common blocks are
refined, never dropped. The ratio of the longest common subsequence decides.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm.components import components
from inkstream.llm.staging import written

#: Least length of an indexed suffix, keys in a block beyond which it is refined, and least ratio of the common subsequence.
LEAST_SUFFIX = 4
MOST_IN_BLOCK = 200
LEAST_RATIO = 0.8
#: Rows of the table of given names, which every task holds, at most.
GIVEN_ROWS = 100_000

#: Titles before or after names, suffixes of names, words for kinds of organisations, and words that say nothing.
TITLES = frozenset("dr prof professor mr mrs ms miss sir ing eng dipl herr frau mme mlle دکتر مهندس سید سیده استاد پروفسور آقای خانم جناب دكتر".split())
SUFFIXES = frozenset("jr sr ii iii iv phd md".split())
ORGANISATIONS = frozenset("institute institut inst university universität université univ centre center ctr cntr laboratory lab laboratoire society soc school department dept academy college faculty association assoc ltd inc gmbh company co organization organisation foundation council committee commission consortium ministry agency bureau museum library press hospital observatory".split())
FILLERS = frozenset("the of for at and in de des du der die das für la le et & an".split())
#: Abbreviations that are not the beginning of the word.
ABBREVIATIONS = {"ctr": "centre", "cntr": "centre", "center": "centre", "dept": "department"}
#: Persian letters in Latin script, one letter each so that one slip stays one slip; and Latin spellings of one sound in Persian names.
LATIN = {
    "ا": "a", "آ": "a", "أ": "a", "إ": "e", "ب": "b", "پ": "p", "ت": "t", "ث": "s", "ج": "j", "چ": "č", "ح": "h", "خ": "x", "د": "d", "ذ": "z", "ر": "r", "ز": "z", "ژ": "ž",
    "س": "s", "ش": "š", "ص": "s", "ض": "z", "ط": "t", "ظ": "z", "ع": "", "غ": "ğ", "ف": "f", "ق": "ğ", "ک": "k", "ك": "k", "گ": "g", "ل": "l", "م": "m", "ن": "n", "و": "u", "ه": "h",
    "ة": "h", "ی": "i", "ي": "i", "ى": "i", "ئ": "i", "ؤ": "u", "ء": "",
}
SOUNDS = (("ch", "č"), ("sh", "š"), ("kh", "x"), ("zh", "ž"), ("gh", "ğ"), ("ee", "i"), ("aa", "a"), ("oo", "u"), ("ou", "u"))
_WORD = re.compile(r"[^\W\d_]+")


def one_slip(a: str, b: str) -> bool:
    """Whether ``a`` becomes ``b`` by at most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the letters of ``a`` as bits of one number."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & at.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return len(a) - open_.bit_count()


def common_ratio(a: str, b: str) -> float:
    """Length of the longest common subsequence over the mean length; 1 for two empty strings."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def least_ratio(a: str, b: str) -> float:
    """The ratio that one wrong, missing or misplaced letter of the longer word leaves, LEAST_RATIO at least."""
    return max(LEAST_RATIO, 2 * (max(len(a), len(b)) - 1) / max(len(a) + len(b), 1))


def alike(a: str, b: str) -> bool:
    """Whether two words are spellings of one by the ratio of their common subsequence."""
    return a == b or (abs(len(a) - len(b)) < 2 and common_ratio(a, b) >= least_ratio(a, b))


def shortened(word: str) -> set[str]:
    """``word`` and what it is with one letter left out: two words that differ by one letter share one."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


@lru_cache(1 << 16)
def plain(text: str) -> str:
    """Case and marks set aside; letters that are written with their mark as one character in Persian stay."""
    kept = (c for c in unicodedata.normalize("NFD", text.casefold().replace("\u200c", "")) if not unicodedata.combining(c) or c in "\u0653\u0654")
    return unicodedata.normalize("NFC", "".join(kept))


def to_latin(word: str, persian: bool = False) -> str:
    """``word`` (plain) in Latin letters; with ``persian``, Latin spellings of Persian sounds become the same letters."""
    out = "".join(LATIN.get(c, c) for c in word)
    if persian:
        for a, b in SOUNDS:
            out = out.replace(a, b)
    return out


class GivenNames:
    """Given names with their short and Latin forms, from a table of at most GIVEN_ROWS rows; more raise an error.

    Forms are indexed by what they are with one letter left out, so a word is
    compared with the few forms that share one of these with it.
    """

    def __init__(self, rows: list[tuple[str | None, str | None, str | None]]):
        if len(rows) > GIVEN_ROWS:
            raise ValueError(f"the table of given names has more than {GIVEN_ROWS} rows")
        self.exact: dict[str, str] = {}
        self.persian: set[str] = set()
        self.forms: dict[str, str] = {}
        for given, short, latin in rows:
            if given:
                canonical = plain(latin or given)
                if latin:
                    self.persian.add(canonical)
                for form in (given, latin, short):
                    if form:
                        self.exact.setdefault(form.casefold(), canonical)
                        self.forms.setdefault(plain(form), canonical)
        for form, canonical in list(self.forms.items()):
            self.forms.setdefault(to_latin(form), canonical)
        self.cache: dict[str, str | None] = {}
        self.near_exact, self.near_forms = _index(self.exact), _index(self.forms)

    def resolve(self, word: str) -> str | None:
        """The canonical given name of ``word`` as written, allowing one slip in three letters or more, if there is just one."""
        if word not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = self._resolve(word)
        return self.cache[word]

    def _resolve(self, word: str) -> str | None:
        bare = plain(word)
        if word in self.exact:
            return self.exact[word]
        if bare == word and bare in self.forms:
            return self.forms[bare]
        marks = {c for c in word if c > "\x7f"}
        for form, table, index in ((word, self.exact, self.near_exact), (bare, self.forms, self.near_forms), (to_latin(bare), self.forms, self.near_forms)):
            if len(form) < 3:
                continue
            near = [(f, table[f]) for f in {f for s in shortened(form) for f in index.get(s, ())} if one_slip(form, f)]
            for narrower in (lambda f: True, lambda f: {c for c in f if c > "\x7f"} == marks, lambda f: len(f) > 4, lambda f: f[0] == form[0]):
                near = [x for x in near if narrower(x[0])] or near
                if len({c for _, c in near}) == 1:
                    return near[0][1]
        return self.forms.get(bare)


def _index(forms: dict[str, str]) -> dict[str, list[str]]:
    """The forms of more than two letters by each of their :func:`shortened`."""
    out: dict[str, list[str]] = {}
    for form in forms:
        if len(form) > 2:
            for s in shortened(form):
                out.setdefault(s, []).append(form)
    return out


_LONG_ORGANISATIONS = _index({w: w for w in ORGANISATIONS if len(w) > 6})


@lru_cache(1 << 16)
def _is_kind(word: str) -> bool:
    """Whether ``word`` (plain) is a kind of organisation, allowing one slip in seven letters or more."""
    return word in ORGANISATIONS or (len(word) > 6 and any(one_slip(word, o) for s in shortened(word) for o in _LONG_ORGANISATIONS.get(s, ())))


#: A key: kind (p or o, w for an organisation's words), family or place, given name or words (null if only an initial is known), initial.
Key = tuple[str, str, str | None, str | None]


def key_of(name: str | None, givens: GivenNames) -> Key | None:
    """The key of one written name; None if nothing identifies it."""
    from inkstream.llm.lookalikes import one_form

    if not name or not name.strip():
        return None
    text = unicodedata.normalize("NFKC", one_form(name, True)).casefold().replace("\u200c", "")
    written_words = _WORD.findall(text)
    words = [plain(w) for w in written_words]
    if any(map(_is_kind, words)):
        return _organisation(words)
    words = [w for w in written_words if plain(w) not in TITLES and plain(w) not in SUFFIXES] or written_words
    full = [w for w in words if len(w) > 1]
    if not full:
        return None
    given_at = [i for i, w in enumerate(full) if givens.resolve(w)]
    if len(full) > 2 and len(full) == len(words) and not given_at and not re.search("[,،]", text):
        # three words or more, none of them a given name or an initial
        return _organisation([plain(w) for w in full])
    if len(full) > 1 and given_at:
        # the surest given name is the one written exactly; the family is the longest other word
        at = min(given_at, key=lambda i: (plain(full[i]) not in givens.forms, i))
        family = max((w for i, w in enumerate(full) if i != at), key=len)
        given = givens.resolve(full[at])
        return "p", to_latin(plain(family), given in givens.persian), given, None
    # "Family, Given" or the longest word
    before = [w for w in _WORD.findall(re.split("[,،]", text)[0]) if w in full] if re.search("[,،]", text) else full
    family = max(before or full, key=len)
    rest = [w for w in full if w != family]
    if rest:
        return "p", to_latin(plain(family)), to_latin(plain(rest[0])), None
    initials = [plain(w) for w in words if len(w) == 1]
    return "p", to_latin(plain(family)), None, initials[0] if initials else ""


def _organisation(words: list[str]) -> Key | None:
    """Place: of the words that are no kind of organisation, the first, or the last if the kind comes first; the rest by their first three letters, sorted."""
    words = [ABBREVIATIONS.get(w, w) for w in words if w not in FILLERS]
    if not words:
        return None
    kinds = [i for i, w in enumerate(words) if _is_kind(w)]
    others = [i for i in range(len(words)) if i not in kinds] or [0]
    # "Place Institute for ..." or "Institute for ... at Place"
    place = others[-1] if kinds and kinds[0] == 0 else others[0]
    rest = sorted(w[:3] for i, w in enumerate(words) if i != place)
    return "o", words[place], " ".join(rest), None


def keys_of(name: str | None, givens: GivenNames) -> list[Key]:
    """The keys of one written name: :func:`key_of`, and for an organisation all its words in alphabetical order, whatever order they are written in."""
    key = key_of(name, givens)
    if key is None or key[0] != "o":
        return [key] if key else []
    from inkstream.llm.lookalikes import one_form

    text = unicodedata.normalize("NFKC", one_form(name, True)).casefold().replace("\u200c", "")
    words = sorted(w for w in map(plain, _WORD.findall(text)) if w not in FILLERS)
    return [key, ("w", " ".join(words), "", None)]


def single_authors(entries: DataFrame) -> DataFrame:
    """(mention, name) of the ``entries`` (bib_id, author) whose author holds exactly one name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from inkstream.operators.packed_values import split_authors

        for batch in batches:
            rows, names = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                items = split_authors(value)
                if len(items) == 1:
                    rows.append(i)
                    names.append(items[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string())], names=["mention", "name"])

    rows = entries.where("bib_id is not null").select(F.concat(F.lit("b"), "bib_id").alias("mention"), F.col("author").cast("string"))
    return rows.mapInArrow(run, "mention string, name string").distinct()


def mention_keys(mentions: DataFrame, givens: GivenNames) -> DataFrame:
    """(mention, kind, family, given, initial): the keys of ``mentions`` (mention, name); names without a key have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            keys = [keys_of(n, givens) for n in coded.dictionary.to_pylist()]
            rows, found = [], []
            for i, k in enumerate(coded.indices.to_pylist()):
                for key in keys[k] if k is not None else ():
                    rows.append(i)
                    found.append(key)
            columns = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], names=["mention", "kind", "family", "given", "initial"])

    return mentions.select("mention", "name").mapInArrow(run, "mention string, kind string, family string, given string, initial string")


def _compatible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the candidate pairs whose families are alike by the ratio of their common subsequence."""
    for batch in batches:
        a, b = (batch.column(i).to_pylist() for i in (1, 3))
        yield batch.filter(pa.array([alike(x, y) for x, y in zip(a, b, strict=True)], pa.bool_()))


def _blocks(family: Column) -> Column:
    """The suffix of half the word and its counterpart from the other end, LEAST_SUFFIX letters at least; of short words the :func:`_slips`.

    A slip may leave no LEAST_SUFFIX letters whole in a word of at most twice
    as many, so those are also blocked exactly. Two words with one letter
    wrong, missing or swapped with its neighbour share a block.
    """
    half = F.greatest(F.lit(LEAST_SUFFIX), F.floor((F.length(family) - 2) / 2).cast("int"))
    shorter = F.greatest(F.lit(LEAST_SUFFIX), half - 1)
    ends = lambda n, s: F.concat(F.lit(s), F.right(family, n) if s == ">" else F.left(family, n))
    halves = F.array(ends(half, ">"), ends(half, "<"), ends(shorter, ">"), ends(shorter, "<"))
    slips = F.when(F.length(family) <= 2 * LEAST_SUFFIX, F.transform(_slips(family), lambda s: F.concat(F.lit("="), s))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.when(F.length(family) >= 2 * LEAST_SUFFIX, halves).otherwise(F.array().cast("array<string>")), slips))


def _slips(family: Column) -> Column:
    """``family`` with each one of its letters left out, and itself."""
    return F.array_distinct(F.concat(F.array(family), F.transform(F.sequence(F.lit(1), F.greatest(F.length(family), F.lit(1))), lambda i: F.concat(F.expr("''"), F.substring(family, F.lit(1), i - 1), F.substring(family, i + 1, F.length(family))))))


def near_families(keys: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(id, family, other_id, other): keys of one kind and given name whose families are alike, among ``keys`` or between them and ``others``.

    Both (id, kind, family, given) are distinct. A block with more than
    MOST_IN_BLOCK keys is refined by the word with one letter left out, which
    two words that are alike share; no block is dropped.
    """
    same = others is None
    sided = keys.withColumn("side", F.lit(3 if same else 1))
    if others is not None:
        sided = sided.unionByName(others.withColumn("side", F.lit(2)))
    blocked = sided.select("id", "kind", "family", "given", "side", F.explode(_blocks(F.col("family"))).alias("block"))
    # only blocks with keys of both sides, two keys at least
    sizes = blocked.groupBy("kind", "given", "block").agg(F.count("*").alias("n"), F.bit_or("side").alias("sides")).where("n > 1 and sides = 3").drop("sides")
    blocked = blocked.join(sizes, ["kind", "given", "block"])
    refined = F.when(F.col("n") <= MOST_IN_BLOCK, F.array(F.lit(""))).otherwise(F.transform(_slips(F.col("family")), lambda s: F.concat(F.lit("|"), s)))
    blocked = blocked.select("id", "kind", "family", "given", "side", "block", F.explode(refined).alias("slip"))
    both = written(blocked)  # a self-join would plan all of this twice
    left, right = both.where("side in (1, 3)").drop("side"), both.where("side in (2, 3)").drop("side").withColumnsRenamed({"family": "other", "id": "other_id"})
    found = left.join(right, ["kind", "given", "block", "slip"]).where("id < other_id" if same else "family <> other")
    return found.select("id", "family", "other_id", "other").distinct().mapInArrow(_compatible, "id bigint, family string, other_id bigint, other string")


def numbered(mentions: DataFrame, givens: GivenNames) -> tuple[DataFrame, DataFrame]:
    """(id, kind, family, given) of every distinct key, and (mention, kind, id): the keys of every mention.

    An initial in place of a given name is a key of kind i. Numbers are given
    once and written, so what follows joins and compares integers.
    """
    short = F.col("given").isNull()
    kind, given = F.when(short, F.lit("i")).otherwise(F.col("kind")), F.when(short, F.coalesce("initial", F.lit(""))).otherwise(F.col("given"))
    keyed = written(mention_keys(mentions, givens).select("mention", kind.alias("kind"), "family", given.alias("given")).distinct())
    keys = written(keyed.select("kind", "family", "given").distinct().withColumn("id", F.monotonically_increasing_id()).select("id", "kind", "family", "given"))
    return keys, written(keyed.join(keys, ["kind", "family", "given"]).select("mention", "kind", "id"))


def linked(mentions: DataFrame, givens: GivenNames) -> DataFrame:
    """(mention, entity) for ``mentions`` (mention, name, contact); mentions with the same number are of one entity.

    A mention may come in several rows with different names; ``contact`` is a
    value that belongs to one person only, or null. Mentions without a name
    that identifies anything are left out. Names with only an initial join the
    one member of their family that it fits; if several fit, a contact decides,
    and without one they stay by themselves.
    """
    keys, keyed = numbered(mentions, givens)
    full = keyed.where("kind <> 'i'")
    near = near_families(keys.where("kind in ('p', 'o')"))
    edges = near.select(F.col("id").alias("a"), F.col("other_id").alias("b"))
    # all names of one mention are one entity's
    first = full.groupBy("mention").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("mention", "a")
    edges = edges.unionByName(first.join(full, "mention").select("a", F.col("id").alias("b")).where("a <> b"))
    contact = mentions.where("contact is not null").select("mention", "contact").distinct()
    # so are the names of one contact
    by_contact = full.where("kind = 'p'").join(contact, "mention").select("contact", "id").distinct()
    hub = by_contact.groupBy("contact").agg(F.min("id").alias("hub"))
    edges = edges.unionByName(by_contact.join(hub, "contact").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")))
    rooted = written(keys.where("kind <> 'i'").join(components(edges).withColumnRenamed("node", "id"), "id", "left").withColumn("entity", F.coalesce("root", "id")).drop("root"))
    entity_of = rooted.select("id", "entity")
    named = full.join(entity_of, "id").groupBy("mention").agg(F.min("entity").alias("entity"))
    short = keyed.where("kind = 'i'").join(full, "mention", "left_anti").select("mention", "id")
    short = short.join(keys.where("kind = 'i'").select("id", F.concat_ws("|", "family", "given").alias("name")), "id")
    resolved = _by_initial(keys.where("kind = 'i'"), rooted.where("kind = 'p'"), givens)
    hubs = hub.join(entity_of.withColumnRenamed("id", "hub"), "hub").select("contact", F.col("entity").alias("by_contact"))
    # of several contacts or names the smallest one counts: numbers differ from run to run
    contacts = contact.join(hubs, "contact").groupBy("mention").agg(F.min_by("by_contact", "contact").alias("by_contact"))
    rest = short.join(resolved, "id", "left").groupBy("mention").agg(F.min_by("by_name", F.when(F.col("by_name").isNotNull(), F.col("name"))).alias("by_name"), F.min_by("id", "name").alias("own"))
    rest = rest.join(contacts, "mention", "left").select("mention", F.coalesce("by_contact", "by_name", "own").alias("entity"))
    return named.unionByName(rest)


def _by_initial(short: DataFrame, members: DataFrame, givens: GivenNames) -> DataFrame:
    """(id, by_name) of the keys ``short``: the only entity of the family, or of a family alike, that the initial fits."""
    fits: dict[str, set[str]] = {}
    for form, canonical in givens.forms.items():
        fits.setdefault(canonical, set()).add(form[0])
    table = short.sparkSession.createDataFrame([(g, sorted(i)) for g, i in sorted(fits.items())], "given string, initials array<string>")
    # GIVEN_ROWS rows at most; every member under each initial that fits its given name, and under none
    initials = F.concat(F.array(F.lit("")), F.coalesce("initials", F.array(F.substring("given", 1, 1))))
    fitting = members.join(F.broadcast(table), "given", "left").select("family", F.explode(initials).alias("given"), "entity")
    fitting = fitting.groupBy("family", "given").agg(F.min("entity").alias("by_name"), F.max("entity").alias("last"))
    fitting = written(fitting.withColumn("kind", F.lit("i")).withColumn("id", F.monotonically_increasing_id()))
    found = written(short.join(fitting.select("family", "given", "by_name", "last"), ["family", "given"], "left"))
    done = found.where("by_name = last").select("id", "by_name")
    # a slip in the family of a name with an initial: compare with the families of the same initial
    key = ("id", "kind", "family", "given")
    near = near_families(found.where("by_name is null and given <> ''").select(*key), fitting.where("given <> ''").select(*key))
    near = near.select("id", "other_id").join(fitting.select(F.col("id").alias("other_id"), "by_name", "last"), "other_id")
    near = near.groupBy("id").agg(F.min("by_name").alias("by_name"), F.max("last").alias("last"))
    return done.unionByName(near.where("by_name = last").select("id", "by_name"))


def entities(members: DataFrame) -> DataFrame:
    """(mention, entity, n_mentions): every mention with the smallest mention of its entity and the entity's size."""
    members = written(members)
    sizes = members.groupBy("entity").agg(F.min("mention").alias("name"), F.count("*").alias("n_mentions"))
    return members.join(sizes, "entity").select("mention", F.col("name").alias("entity"), "n_mentions")


def pairs(members: DataFrame) -> DataFrame:
    """(key_a, key_b): every pair of mentions of one entity, the smaller string first."""
    members = written(members)
    a, b = members.withColumnRenamed("mention", "key_a"), members.withColumnRenamed("mention", "key_b")
    return a.join(b, "entity").where("key_a < key_b").select("key_a", "key_b")
