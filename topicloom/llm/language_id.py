"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: log-likelihood under byte-trigram models, one per language and one uniform model
  for ``und``, text in none of them. Models are counted over all rows that declare a language.
* Declaration: how often each language, as the text tells it, comes with each declared code.
* Address suffix: the same for the last label of a host name.
* Host: a prior smoothed hierarchically, host to suffix to all rows, without the row's own share.

The last three are grouped aggregates of the text posteriors, so they need no true labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import LOWER, join_groups, text_slices
from topicloom.stash import stash

UNKNOWN = "und"

# Fixed list: the codes of ISO 639-1 (with five withdrawn ones) and ISO 639-2, and codes of ISO 639-3 for
# further languages that are often written. Codes for no, several or uncoded languages are left out.
ISO_639 = frozenset(
    """
aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el
en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik in io is it
iu iw ja ji jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mo mr
ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg sh si
sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi
yo za zh zu aar abk ace ach ada ady afa afh afr ain aka akk alb ale alg als alt amh ang anp apa ara arc arg
arm arn arp art arw arz asm ast ath aus ava ave awa aym azb aze bad bai bak bal bam ban baq bar bas bat bcl
bej bel bem ben ber bho bih bik bin bis bjn bla bnt bod bos bpy bra bre btk bua bug bul bur byn cad cai car
cat cau ceb cel ces cha chb che chg chi chk chm chn cho chp chr chu chv chy ckb cmc cmn cnr cop cor cos cpe
cpf cpp cre crh crp csb cus cym cze dak dan dar day del den deu dgr din div doi dra dsb dty dua dum dut dyu
dzo efi egy eka ell elx eng enm epo est eus ewe ewo ext fan fao fas fat fij fil fin fiu fon fra fre frm fro
frp frr frs fry ful fur gaa gag gan gay gba gem geo ger gez gil gla gle glg glk glv gmh goh gom gon gor got
grb grc gre grn gsw guj gwi hai hak hat hau haw heb her hif hil him hin hit hmn hmo hrv hsb hun hup hye iba
ibo ice ido iii ijo iku ile ilo ina inc ind ine inh ipk ira iro isl ita jam jav jbo jpn jpr jrb kaa kab kac
kal kam kan kar kas kat kau kaw kaz kbd kha khi khm kho kik kin kir kmb kmr koi kok kom kon kor kos kpe krc
krl kro kru ksh kua kum kur kut lad lah lam lao lat lav lez lij lim lin lit lmo lol loz lrc ltg ltz lua lub
lug lui lun luo lus lzh mac mad mag mah mai mak mal man mao map mar mas may mdf mdr men mga mhr mic min mkd
mkh mlg mlt mnc mni mno moh mon mos mri mrj msa mun mus mwl mwr mya myn myv mzn nah nai nan nap nau nav nbl
nde ndo nds nep new nia nic niu nld nno nob nog non nor nov nqo nso nub nwc nya nym nyn nyo nzi oci oji olo
ori orm osa oss ota oto paa pag pal pam pan pap pau pcd pdc peo per pfl phi phn pli pms pnb pnt pol pon por
pra pro prs pus que raj rap rar rmy roa roh rom ron rue rum run rup rus sad sag sah sai sal sam san sas sat
scn sco sel sem sga sgn sgs shn sid sin sio sit skr sla slk slo slv sma sme smi smj smn smo sms sna snd snk
sog som son sot spa sqi srd srn srp srr ssa ssw stq suk sun sus sux swa swe syc syr szl tah tai tam tat tcy
tel tem ter tet tgk tgl tha tib tig tir tiv tkl tlh tli tmh tog ton tpi tsi tsn tso tuk tum tup tur tut tvl
twi tyv udm uga uig ukr umb urd uzb vai vec ven vep vie vls vol vot vro wak wal war was wel wen wln wol wuu
xal xho xmf yao yap yid yor ypk yue zap zbl zea zen zgh zha zho znd zsm zul zun zza
""".split()
)


@dataclass(frozen=True)
class Settings:
    """``min_rows``: least rows that declare a language; no corpus grows too large for them.

    A code outside ``ISO_639``, and a suffix, needs ``min_share`` of the rows. So there are at most
    1/min_share models besides those of the list. A language below that share starts from a prior
    as much lower.
    ``enough`` trigrams are all the text can weigh; ``kappa`` rows is the weight of a parent
    in the host prior; a row needs ``min_posterior`` for a language to be accepted.
    """

    min_rows: int = 5
    min_share: float = 0.005
    bits: int = 14
    enough: int = 300
    kappa: float = 20.0
    und_prior: float = 1e-6
    min_posterior: float = 0.5


# Letters (any byte of a non-ASCII character counts as one) and the space between words.
_CODES = np.arange(256)
WRITTEN = ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128) | (_CODES == 32)


def trigrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(feature, inside)`` at each byte: hashed trigram from there, and whether it counts.

    It counts when it lies within one text and has letters and spaces only: numbers, keys and
    punctuation say nothing about the language.
    """
    rng = np.random.default_rng(7)
    tables = rng.integers(0, 1 << bits, (3, 256)).astype(np.int32)
    low = LOWER[data]
    feature = np.zeros(low.size, np.int32)
    inside = np.zeros(low.size, bool)
    if low.size >= 3:
        feature[:-2] = tables[0][low[:-2]] ^ tables[1][low[1:-1]] ^ tables[2][low[2:]]
        written = WRITTEN[low]
        inside[:-2] = written[:-2] & written[1:-1] & written[2:]
        for back in (1, 2):
            at = offsets[1:] - back
            inside[at[at >= 0]] = False
    return feature, inside


def declared_languages(rows: DataFrame, settings: Settings) -> dict[str, float]:
    """Codes to model, sorted, each with its share of the declared rows.

    All codes of ``min_share`` of these rows, and those of ``ISO_639`` with ``min_rows``; bounded by
    counting and by the list.
    """
    counts = rows.where("declared IS NOT NULL").groupBy("declared").count()
    total = rows.agg(F.count("declared")).first()[0]
    listed = F.col("declared").isin(sorted(ISO_639)) & (F.col("count") >= settings.min_rows)
    kept = counts.where(listed | (F.col("count") >= max(1, settings.min_share * total)))
    return {code: n / total for code, n in sorted(map(tuple, kept.collect()))}


def trigram_models(rows: DataFrame, languages: list[str], settings: Settings) -> np.ndarray:
    """Log-probabilities (languages and ``und`` x features), counted over all declared rows."""
    size, number = 1 << settings.bits, {code: k for k, code in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), size), np.int64)
        for batch in batches:
            code = np.array([number.get(x, -1) for x in batch.column(0).to_pylist()])
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                feature, inside = trigrams(data, offsets, settings.bits)
                owner = np.repeat(code[lo:hi], np.diff(offsets))
                ok = inside & (owner >= 0)
                flat = owner[ok] * size + feature[ok]
                counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        language, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(language, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[language, at])],
            ["language", "feature", "n"],
        )

    summed = (
        rows.select("declared", "text")
        .mapInArrow(run, "language int, feature int, n long")
        .groupBy("language", "feature")
        .agg(F.sum("n").alias("n"))
    )
    counts = np.full((len(languages), size), 0.5)
    # At most languages x features rows, whatever the corpus.
    cells = summed.toArrow()
    counts[cells["language"].to_numpy(), cells["feature"].to_numpy()] += cells["n"].to_numpy()
    model = np.log(counts / counts.sum(axis=1, keepdims=True)) if languages else counts
    return np.vstack([model, np.full((1, size), -log(size))]).astype(np.float32)


def with_text_evidence(rows: DataFrame, models: np.ndarray, settings: Settings) -> DataFrame:
    """``rows`` without ``text`` and with ``ll`` (array by language, ``und`` last) and ``n``."""
    rest = [c for c in rows.columns if c != "text"]
    schema = T.StructType(
        [rows.schema[c] for c in rest]
        + [T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(len(rest))):
                feature, inside = trigrams(data, offsets, settings.bits)
                score = np.zeros((hi - lo, len(models)))
                full = np.flatnonzero(np.diff(offsets))
                heads = offsets[:-1][full]
                n = np.zeros(hi - lo, np.int64)
                if full.size:
                    n[full] = np.add.reduceat(inside.astype(np.int64), heads)
                    for k, model in enumerate(models):
                        score[full, k] = np.add.reduceat(np.where(inside, model[feature], 0.0), heads)
                score *= (1 / (1 + n / settings.enough))[:, None]
                part = batch.slice(lo, hi - lo)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(hi - lo + 1, dtype=np.int32) * len(models)), pa.array(score.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(len(rest))] + [lists, pa.array(n)], schema.names
                )

    return rows.select(*rest, "text").mapInArrow(run, schema)


def softmax(scores: Column) -> Column:
    best = F.array_max(scores)
    raised = F.transform(scores, lambda x: F.exp(x - best))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def doubles(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def sums(posterior: str, k: int) -> list[Column]:
    return [F.sum(F.get(posterior, i)).alias(f"s{i}") for i in range(k)]


def with_row(rows: DataFrame, key: str, found: dict[str, np.ndarray], name: str, default) -> DataFrame:
    """Add array ``name`` by the value of ``key``, ``default`` where none is found; the values are few."""
    other = doubles(default)
    if not found:
        return rows.withColumn(name, other)
    table = pa.table({key: list(found), "found": pa.array([list(map(float, x)) for x in found.values()])})
    joined = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table)), key, "left")
    return joined.withColumn(name, F.coalesce("found", other)).drop("found")


def _likelihoods(table: DataFrame, key: str, k: int) -> dict[str, np.ndarray]:
    """Log-likelihood by language of each value of ``key``; the values are few by their bound."""
    counts = {r[0]: np.array(r[1:]) for r in table.groupBy(key).agg(*sums("posterior", k)).collect()}
    counts.pop(None, None)
    total = sum(counts.values()) + len(counts)
    return {value: np.log((c + 1) / total) for value, c in counts.items()}


def identify_languages(
    rows: DataFrame,
    text: str = "text",
    declared: str | None = "lang",
    host: str | None = "source",
    settings: Settings = Settings(),
) -> DataFrame:
    """``(record, predicted, posterior, accepted)``: each whole row of ``rows`` as a struct.

    ``declared`` names the column of declared codes (region and case are dropped), ``host`` that
    of host names; a host without a dot has no suffix. Missing or null evidence counts for
    nothing; codes without a model count as one value, and so do suffixes of less than ``min_share``
    of the rows.
    Null and empty texts leave the other evidence to decide. A row is accepted unless it
    is ``und`` or its language has less than ``min_posterior``. Rows that nobody labels give no
    language, so all are ``und``; an empty table gives an empty result.
    """
    none = F.lit(None).cast("string")
    code = F.lower(F.regexp_extract(F.col(declared), "^([A-Za-z]+)", 1)) if declared else none
    name = F.lower(F.col(host)) if host else none
    kept = [c for c in rows.columns]
    prepared = rows.select(
        F.struct(*kept).alias("record"),
        F.when(code != "", code).alias("declared"),
        name.alias("host"),
        F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).alias("suffix"),
        F.col(text).alias("text"),
    )
    shares = declared_languages(prepared, settings)
    languages = [x for x in shares if x != UNKNOWN]
    models = trigram_models(prepared, languages, settings)
    classes, k = [*languages, UNKNOWN], len(languages) + 1
    weights = np.array([min(1.0, shares[x] / settings.min_share) for x in languages])
    flat = doubles([*np.log((1 - settings.und_prior) * weights / weights.sum()), log(settings.und_prior)])
    evidence = with_text_evidence(prepared, models, settings)
    evidence = stash(evidence.withColumn("posterior", softmax(plus(F.col("ll"), flat))), "evidence")

    n_rows = evidence.agg(F.count("*"), *sums("posterior", k)).first()
    total, everywhere = n_rows[0], np.array([x or 0.0 for x in n_rows[1:]])
    world = (everywhere + 1) / (total + k)
    common = [
        r[0]
        for r in evidence.where("suffix IS NOT NULL")
        .groupBy("suffix")
        .count()
        .where(F.col("count") >= max(1, settings.min_share * total))
        .collect()
    ]
    other = F.lit("*")
    known = evidence.withColumns(
        {
            "declared": F.when(F.col("declared").isin(languages) | F.col("declared").isNull(), F.col("declared")).otherwise(other)
            if languages
            else none,
            "suffix": F.when(F.col("suffix").isin(common) | F.col("suffix").isNull(), F.col("suffix")).otherwise(other)
            if common
            else none,
        }
    )
    # Host priors: shares by host, drawn towards those of its suffix, and these towards all rows.
    kappa = settings.kappa
    suffixes = known.groupBy("suffix").agg(F.count("*").alias("m"), *sums("posterior", k)).collect()
    parents = {r[0]: (np.array(r[2:]) + kappa * world) / (r[1] + kappa) for r in suffixes if r[0] is not None}
    hosts = stash(
        known.where("host IS NOT NULL")
        .groupBy("host")
        .agg(F.count("*").alias("host_rows"), *sums("posterior", k))
        .select("host", "host_rows", F.array(*[f"s{i}" for i in range(k)]).alias("host_sums")),
        "hosts",
    )
    joined = join_groups(known, hosts, ["host"], "host_rows", ["n", "declared", "record"], total)
    joined = with_row(joined, "suffix", parents, "parent", world)
    own = F.zip_with("host_sums", "posterior", lambda s, p: F.greatest(s - p, F.lit(0.0)))
    local = F.zip_with(own, "parent", lambda s, p: (s + kappa * p) / (F.col("host_rows") - 1 + kappa))
    prior = F.transform(F.coalesce(local, F.col("parent")), lambda p: F.log(p))
    score = plus(F.col("ll"), prior)
    for key in ("declared", "suffix"):
        joined = with_row(joined, key, _likelihoods(known, key, k), f"{key}_likelihood", np.zeros(k))
        score = plus(score, F.col(f"{key}_likelihood"))
    fused = joined.select("record", softmax(score).alias("p"))
    best = F.array_max("p")
    names = F.array(*[F.lit(c) for c in classes])
    out = fused.select(
        "record", F.element_at(names, F.array_position("p", best).cast("int")).alias("predicted"), best.alias("posterior")
    )
    accepted = (F.col("predicted") != UNKNOWN) & (F.col("posterior") >= settings.min_posterior)
    return out.withColumn("accepted", accepted)
