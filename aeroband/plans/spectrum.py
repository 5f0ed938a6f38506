"""Registered queries: spectra, peaks, noise floors, samples, modulation and the frame detector."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroband.functions import arrays as X, numeric
from aeroband.functions.numeric import rounded
from aeroband.operators import baselines as B, iq as I, ordered, peaks as K, spectral as S, transforms as T
from aeroband.plans import views as V
from aeroband.plans.registry import query
from aeroband.plans.sequences import FRAME, MAXIMA
from aeroband.session import table

C = F.col
FS, CENTRE = 2e6, 2.45e9
SW2 = "(SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * n / 31), 2)) FROM range(32) t(n))"
WSQL = "PARTITION BY frame_id ORDER BY n"


def frames(spark, d):
    return V.iq_frames(spark, d)


def r6(df):
    return rounded(df, 6)


def struct_rows(df, name, *keep, digits=6):
    """Flatten one struct column and round its doubles."""
    return rounded(df.select(*keep, f"{name}.*"), digits)


# --------------------------------------------------------------------------- spectra
@query("o1_spectra_build", "SELECT frame_id, bin, round(re, 6) AS re, round(im, 6) AS im, 2.45e9 + (bin - 16) * 62500.0 AS freq_hz FROM dft")
def _(spark, d):
    s = T.build_spectra(frames(spark, d), "hann")
    long = s.select("frame_id", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z"))
    return long.select("frame_id", "bin", (F.round("z.re", 6) + 0.0).alias("re"), (F.round("z.im", 6) + 0.0).alias("im"),
                       T.bin_frequency("bin", F.lit(32), FS, CENTRE).alias("freq_hz"))


@query("o2_power_spectrum", "SELECT frame_id, bin, round(re*re+im*im, 6) AS power, round(10*log10(re*re+im*im+1e-12), 4) AS power_db FROM dft")
def _(spark, d):
    s = T.build_spectra(frames(spark, d), "hann").select("frame_id", T.power_spectrum().alias("p"))
    return s.select("frame_id", F.posexplode("p").alias("bin", "x")).select("frame_id", "bin", F.round("x", 6).alias("power"),
                                                                         F.round(numeric.power_db("x"), 4).alias("power_db"))


@query("o3_welch_psd", f"""WITH seg AS (SELECT frame_id, s, n - 8 * s AS m, i, q FROM iq_samples, range(3) t(s) WHERE n >= 8 * s AND n < 8 * s + 16),
   f AS (SELECT frame_id, s, CAST((k + 8) % 16 AS INTEGER) AS bin, sum((0.5 - 0.5*cos(2*pi()*m/15)) * (i*cos(2*pi()*k*m/16) + q*sin(2*pi()*k*m/16))) AS re,
     sum((0.5 - 0.5*cos(2*pi()*m/15)) * (q*cos(2*pi()*k*m/16) - i*sin(2*pi()*k*m/16))) AS im FROM seg, range(16) r(k) GROUP BY 1, 2, 3)
   SELECT frame_id, bin, round(avg((re*re+im*im) / (2e6 * (SELECT sum(pow(0.5 - 0.5*cos(2*pi()*n/15), 2)) FROM range(16) t(n)))) * 1e6, 6) AS psd FROM f GROUP BY 1, 2""")
def _(spark, d):
    w = T.welch(frames(spark, d), FS, 16, 0.5)
    return r6(w.select("frame_id", F.posexplode("psd").alias("bin", "psd")).withColumn("psd", C("psd") * 1e6))


@query("o3_recording_average", """SELECT label, bin, round(avg(psd_db), 6) AS psd FROM spectra GROUP BY 1, 2""")
def _(spark, d):
    return r6(T.average_by(V.psd_frames(spark, d), "label"))


@query("o5_extra_windows")
def _(spark, d):
    out = None
    for w in ("blackman", "blackmanharris", "bartlett", "flattop", "kaiser14", "hamming", "rect"):
        part = T.build_spectra(frames(spark, d), w).select(F.lit(w).alias("window"), "frame_id", X.let(T.power_spectrum(), F.array_max).alias("peak"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("o5_hamming_window", """SELECT frame_id, round(max(re*re+im*im), 6) AS peak FROM (SELECT frame_id, k, sum((0.54-0.46*cos(2*pi()*n/31))*(i*cos(2*pi()*k*n/32)+q*sin(2*pi()*k*n/32))) AS re,
   sum((0.54-0.46*cos(2*pi()*n/31))*(q*cos(2*pi()*k*n/32)-i*sin(2*pi()*k*n/32))) AS im FROM iq_samples, range(32) r(k) GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    return r6(T.build_spectra(frames(spark, d), "hamming").select("frame_id", X.let(T.power_spectrum(), F.array_max).alias("peak")))


@query("o6_spectrogram", """WITH seg AS (SELECT frame_id, s, n - 8 * s AS m, i, q FROM iq_samples, range(3) t(s) WHERE n >= 8 * s AND n < 8 * s + 16),
   f AS (SELECT frame_id, s, CAST((k + 8) % 16 AS INTEGER) AS bin, sum((0.5 - 0.5*cos(2*pi()*m/15)) * (i*cos(2*pi()*k*m/16) + q*sin(2*pi()*k*m/16))) AS re,
     sum((0.5 - 0.5*cos(2*pi()*m/15)) * (q*cos(2*pi()*k*m/16) - i*sin(2*pi()*k*m/16))) AS im FROM seg, range(16) r(k) GROUP BY 1, 2, 3)
   SELECT frame_id, CAST(s AS INTEGER) AS segment, bin, round((re*re+im*im) / (2e6 * (SELECT sum(pow(0.5 - 0.5*cos(2*pi()*n/15), 2)) FROM range(16) t(n))) * 1e6, 6) AS psd FROM f""")
def _(spark, d):
    s = T.spectrogram(frames(spark, d), FS, 16, 0.5)
    return r6(s.select("frame_id", "segment", F.posexplode("psd").alias("bin", "psd")).withColumn("psd", C("psd") * 1e6))


# -------------------------------------------------------------------- sample operators
def long_iq(df, digits=6):
    z = df.select("frame_id", F.posexplode(F.arrays_zip("i", "q")).alias("n", "z"))
    return z.select("frame_id", "n", (F.round("z.i", digits) + 0.0).alias("i"), (F.round("z.q", digits) + 0.0).alias("q"))


@query("o7_dc_removal", "SELECT frame_id, n, round(i - avg(i) OVER (PARTITION BY frame_id), 6) AS i, round(q - avg(q) OVER (PARTITION BY frame_id), 6) AS q FROM iq_samples")
def _(spark, d):
    return long_iq(frames(spark, d).withColumns({c: I.remove_dc(c) for c in ("i", "q")}))


NORM_SQL = {
    "z_score": ("(i - avg(i) OVER w) / (stddev_pop(i) OVER w + 1e-12)", "(q - avg(q) OVER w) / (stddev_pop(q) OVER w + 1e-12)"),
    "min_max": ("i / max(amp) OVER w", "q / max(amp) OVER w"),
    "robust": ("(i - median(i) OVER w) / (quantile_cont(i, 0.75) OVER w - quantile_cont(i, 0.25) OVER w + 1e-12)",
               "(q - median(q) OVER w) / (quantile_cont(q, 0.75) OVER w - quantile_cont(q, 0.25) OVER w + 1e-12)"),
    "unit": ("i / amp", "q / amp"), "power": ("i / sqrt(avg(p) OVER w)", "q / sqrt(avg(p) OVER w)"),
}
for _m, (_si, _sq) in NORM_SQL.items():
    def _normalise(spark, d, method=_m):
        return long_iq(I.normalise(frames(spark, d), method))
    query(f"o8_normalise_{_m}", f"SELECT frame_id, n, round({_si}, 6) AS i, round({_sq}, 6) AS q FROM iq_power WINDOW w AS (PARTITION BY frame_id)")(_normalise)


@query("o9_outlier_clipping", """SELECT frame_id, n, round(CASE WHEN amp > t THEN i * t / amp ELSE i END, 6) AS i, round(CASE WHEN amp > t THEN q * t / amp ELSE q END, 6) AS q
   FROM (SELECT *, avg(amp) OVER w + 1.5 * stddev_pop(amp) OVER w AS t FROM iq_power WINDOW w AS (PARTITION BY frame_id))""")
def _(spark, d):
    return long_iq(I.clip_outliers(frames(spark, d), 1.5))


@query("o10_imbalance_correction", """WITH s AS (SELECT frame_id, sqrt(avg(q*q)/avg(i*i)) AS g, asin(avg(i*q)/sqrt(avg(i*i)*avg(q*q))) AS f FROM iq_samples GROUP BY 1)
   SELECT x.frame_id, n, round(i * g, 6) AS i, round(q - i * g * f, 6) AS q FROM iq_samples x JOIN s ON s.frame_id = x.frame_id""")
def _(spark, d):
    return long_iq(I.correct_imbalance(frames(spark, d)))


@query("o11_frequency_correction", """WITH o AS (SELECT frame_id, (arg_max(bin, (round(re*re+im*im, 9), -bin)) - 16) * 62500.0 AS hz FROM dft_rect GROUP BY 1)
   SELECT x.frame_id, n, round(i*cos(-2*pi()*hz*n/2e6) - q*sin(-2*pi()*hz*n/2e6), 6) AS i, round(i*sin(-2*pi()*hz*n/2e6) + q*cos(-2*pi()*hz*n/2e6), 6) AS q
   FROM iq_samples x JOIN o ON o.frame_id = x.frame_id""")
def _(spark, d):
    s = T.build_spectra(frames(spark, d), "rect", keep=("frame_id", "i", "q"))
    peak = X.argmax(T.power_spectrum())
    offset = s.withColumn("offset_hz", (peak - 16) * 62500.0)
    return long_iq(I.rotate(offset, "offset_hz", FS))


@query("o12_capture_statistics", """SELECT frame_id, round(avg(i),6) AS mean_i, round(avg(q),6) AS mean_q, round(stddev_pop(i),6) AS std_i, round(stddev_pop(q),6) AS std_q, round(max(amp),6) AS max_abs,
   round(min(amp),6) AS min_abs, round(10*log10(avg(p)+1e-12),6) AS mean_power_db, round(10*log10(max(p)+1e-12),6) AS peak_power_db, round(max(amp)/(sqrt(avg(p))+1e-12),6) AS crest
   FROM iq_power GROUP BY 1""")
def _(spark, d):
    return struct_rows(frames(spark, d).select("frame_id", I.capture_statistics().alias("s")), "s", "frame_id").drop("skewness", "kurtosis")


@query("o13_chunk_mean_power", "SELECT frame_id, round(10*log10(avg(i*i+q*q)+1e-12), 6) AS power_db FROM iq_samples GROUP BY 1")
def _(spark, d):
    return r6(frames(spark, d).select("frame_id", I.mean_power_db().alias("power_db")))


@query("o14_auto_scale", """SELECT frame_id, n, round(i * CASE WHEN m > 0.3 THEN 0.25 / m ELSE 1 END, 6) AS i, round(q * CASE WHEN m > 0.3 THEN 0.25 / m ELSE 1 END, 6) AS q
   FROM (SELECT *, max(amp) OVER (PARTITION BY frame_id) AS m FROM iq_power)""")
def _(spark, d):
    return long_iq(I.auto_scale(frames(spark, d), 0.3, 0.25))


# ------------------------------------------------------------------------ noise floors
@query("o15_floor_percentile", "SELECT frame_id, round(quantile_cont(psd_db, 0.1), 6) AS floor FROM spectra GROUP BY 1")
def _(spark, d):
    return r6(V.psd_frames(spark, d).select("frame_id", S.floor_percentile("psd").alias("floor")))


@query("o16_floor_median", "SELECT frame_id, round(median(psd_db), 6) AS floor FROM spectra WHERE abs(freq_hz - 2.4032e9) >= 250000 GROUP BY 1")
def _(spark, d):
    return r6(V.psd_frames(spark, d).select("frame_id", S.floor_median("psd", centre_hz=2.4032e9, exclude_hz=250e3).alias("floor")))


@query("o17_floor_mode", """WITH b AS (SELECT frame_id, psd_db, min(psd_db) OVER w AS lo, (max(psd_db) OVER w - min(psd_db) OVER w) / 100 AS width FROM spectra WINDOW w AS (PARTITION BY frame_id)),
   c AS (SELECT frame_id, lo, width, least(floor((psd_db - lo) / width), 99) AS s, count(*) AS n FROM b GROUP BY ALL)
   SELECT frame_id, round(arg_max(lo + s * width, (n, -s)), 6) AS floor FROM c GROUP BY 1""")
def _(spark, d):
    return r6(V.psd_frames(spark, d).select("frame_id", S.floor_mode("psd").alias("floor")))


def _clip_sql(rounds):
    parts, src = [], "spectra"
    for k in range(rounds):
        parts.append(f"r{k} AS (SELECT s.frame_id, psd_db FROM {src} s JOIN (SELECT frame_id, avg(psd_db) + 1.2 * stddev_pop(psd_db) AS t FROM {src} GROUP BY 1) u ON u.frame_id = s.frame_id WHERE psd_db < t)")
        src = f"r{k}"
    return "WITH " + ", ".join(parts) + f" SELECT frame_id, round(avg(psd_db), 6) AS floor FROM {src} GROUP BY 1"


@query("o18_floor_iterative", _clip_sql(5))
def _(spark, d):
    return r6(V.psd_frames(spark, d).select("frame_id", S.floor_iterative("psd", 1.2).alias("floor")))


@query("o19_floor_low_quarter", """SELECT frame_id, round(avg(psd_db), 6) AS floor FROM (SELECT *, quantile_cont(psd_db, 0.25) OVER (PARTITION BY frame_id) AS q FROM spectra) WHERE psd_db < q GROUP BY 1""")
def _(spark, d):
    return r6(V.psd_frames(spark, d).select("frame_id", S.floor_low_quarter("psd").alias("floor")))


@query("o20_noise_calibration", """SELECT round(avg(l),6) AS mean, round(stddev_pop(l),6) AS std, round(min(l),6) AS min, round(max(l),6) AS max, round(avg(l)+6,6) AS threshold
   FROM (SELECT quantile_cont(psd_db, 0.1) AS l FROM spectra GROUP BY frame_id)""")
def _(spark, d):
    return r6(S.calibrate(V.psd_frames(spark, d)))


@query("o21_signal_to_noise", """SELECT a.frame_id, peak_snr, energy_snr FROM (SELECT frame_id, round(max(psd_db) - quantile_cont(psd_db, 0.1), 6) AS peak_snr FROM spectra GROUP BY 1) a
   JOIN (SELECT frame_id, round(greatest(0.0, 10*log10(avg(p)/quantile_cont(p, 0.1))), 6) AS energy_snr FROM iq_power GROUP BY 1) b ON a.frame_id = b.frame_id""")
def _(spark, d):
    return r6(_both(spark, d).select("frame_id", (F.array_max("psd") - S.floor_percentile("psd")).alias("peak_snr"), I.energy_snr_db().alias("energy_snr")))


def _both(spark, d):
    """Spectrum and samples of a frame side by side, from one scan."""
    half = F.sequence(F.lit(1), (F.size("embedding") / 2).cast("int"))
    return table(spark, d, "embeddings").select(
        C("vec_id").alias("frame_id"), "label", F.lit(2.4e9).alias("f0_hz"), F.lit(1e5).alias("bin_hz"), F.transform("embedding", lambda x: x.cast("double") * 100).alias("psd"),
        F.transform(half, lambda p: F.element_at("embedding", 2 * p - 1).cast("double")).alias("i"),
        F.transform(half, lambda p: F.element_at("embedding", 2 * p).cast("double")).alias("q"))


# ------------------------------------------------------------------------------- peaks
@query("o22_threshold_peaks", f"""WITH c AS (SELECT frame_id, list([bin] ORDER BY bin) AS cand FROM ({MAXIMA}) WHERE psd_db > 0 GROUP BY 1), e AS (SELECT c.*, embedding FROM c JOIN embeddings ON vec_id = frame_id)
   SELECT frame_id, len(list_reduce(cand, lambda a, b: CASE WHEN b[1] - a[-1] >= 8 THEN list_concat(a, b) WHEN embedding[b[1]+1] > embedding[a[-1]+1] THEN list_concat(a[1:len(a)-1], b) ELSE a END))::INTEGER AS peaks FROM e""")
def _(spark, d):
    return V.psd_frames(spark, d).select("frame_id", F.size(K.detect("psd", 0.0, 8)).alias("peaks")).filter("peaks > 0")


@query("o23_prominent_peaks", f"""WITH m AS ({MAXIMA}),
   s AS (SELECT m.frame_id, m.bin, m.psd_db, (SELECT max(x.bin) FROM spectra x WHERE x.frame_id = m.frame_id AND x.bin < m.bin AND x.psd_db > m.psd_db) AS hl,
     (SELECT min(x.bin) FROM spectra x WHERE x.frame_id = m.frame_id AND x.bin > m.bin AND x.psd_db > m.psd_db) AS hr FROM m WHERE m.psd_db >= 10)
   SELECT frame_id, bin, round(psd_db - greatest((SELECT min(x.psd_db) FROM spectra x WHERE x.frame_id = s.frame_id AND x.bin > coalesce(s.hl, -1) AND x.bin <= s.bin),
     (SELECT min(x.psd_db) FROM spectra x WHERE x.frame_id = s.frame_id AND x.bin >= s.bin AND x.bin < coalesce(s.hr, 64))), 6) AS prominence FROM s""")
def _(spark, d):
    return r6(V.psd_frames(spark, d).select("frame_id", F.inline(K.filtered("psd", height=10.0))).select("frame_id", "bin", "prominence"))


@query("o24_adaptive_peaks", f"""SELECT frame_id, bin FROM (SELECT *, lag(psd_db) OVER ({FRAME}) l, lead(psd_db) OVER ({FRAME}) r, avg(psd_db) OVER ({FRAME} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) + 12.0 AS t FROM spectra)
   WHERE psd_db > l AND psd_db > r AND psd_db > t""")
def _(spark, d):
    return V.psd_frames(spark, d).select("frame_id", F.explode(K.adaptive("psd", 12.0)).alias("bin"))


@query("o25_peak_characterisation", """WITH p AS (SELECT vec_id AS frame_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pk FROM embeddings),
   x AS (SELECT s.*, pk, max(psd_db) OVER (PARTITION BY s.frame_id) AS top FROM spectra s JOIN p ON p.frame_id = s.frame_id)
   SELECT frame_id, pk AS bin, round(max(top), 6) AS power, CAST(coalesce(min(bin) FILTER (WHERE bin >= pk AND psd_db <= top - 3), 63) - coalesce(max(bin) FILTER (WHERE bin <= pk AND psd_db <= top - 3), 0) AS INTEGER) AS width_bins
   FROM x GROUP BY 1, 2""")
def _(spark, d):
    c = X.let("psd", lambda v: X.let(X.argmax(v), lambda i: K.characterise(v, i, 1e5)))
    return r6(V.psd_frames(spark, d).select("frame_id", c.alias("c")).select("frame_id", "c.bin", "c.power", "c.width_bins"))


LIN = "SELECT *, pow(10.0, psd_db / 10) AS lin FROM spectra"


@query("o26_spectrum_parameters", f"""WITH f AS (SELECT *, quantile_cont(psd_db, 0.1) OVER (PARTITION BY frame_id) AS floor, max(psd_db) OVER (PARTITION BY frame_id) AS top, lag(lin) OVER ({FRAME}) AS plin FROM ({LIN})),
   a AS (SELECT frame_id, 10*log10(sum((lin + plin) / 2 * 1e5) / 64) AS avg_power FROM f GROUP BY 1),
   g AS (SELECT frame_id, max(top) AS peak_power, max(floor) AS noise_floor, sum(lin*freq_hz)/sum(lin) AS c, 10*log10(sum(lin)) AS sp FROM f WHERE psd_db > floor + 6 GROUP BY 1),
   v AS (SELECT f.frame_id, 2*sqrt(sum(lin*pow(freq_hz - c, 2))/sum(lin)) AS bw FROM f JOIN g ON g.frame_id = f.frame_id WHERE psd_db > floor + 6 GROUP BY 1)
   SELECT g.frame_id, round(peak_power, 6) AS peak_power, round(noise_floor, 6) AS noise_floor, round(peak_power - noise_floor, 6) AS snr_db, round(avg_power, 6) AS avg_power,
     round(c, 0) AS center_frequency, round(bw, 0) AS bandwidth, round(sp, 6) AS signal_power FROM g JOIN a ON a.frame_id = g.frame_id JOIN v ON v.frame_id = g.frame_id""")
def _(spark, d):
    p = V.psd_frames(spark, d).select("frame_id", S.parameters("psd").alias("p")).select("frame_id", "p.*")
    return p.select("frame_id", *[F.round(c, 0 if c in ("center_frequency", "bandwidth") else 6).alias(c) for c in
                                  ("peak_power", "noise_floor", "snr_db", "avg_power", "center_frequency", "bandwidth", "signal_power")])


@query("o27_occupied_bandwidth", f"""WITH c AS (SELECT frame_id, bin, sum(lin) OVER ({FRAME} ROWS UNBOUNDED PRECEDING) AS cum, sum(lin) OVER (PARTITION BY frame_id) AS tot FROM ({LIN}))
   SELECT frame_id, (min(bin) FILTER (WHERE cum >= 0.995 * tot) - min(bin) FILTER (WHERE cum >= 0.005 * tot)) * 1e5 AS obw_hz FROM c GROUP BY 1""")
def _(spark, d):
    return V.psd_frames(spark, d).select("frame_id", X.let(S.linear("psd"), lambda v: S.occupied_bandwidth(v)).alias("obw_hz"))


@query("o28_band_occupancy", f"""WITH f AS (SELECT frame_id, bin, psd_db > quantile_cont(psd_db, 0.1) OVER (PARTITION BY frame_id) + 6 AS occ FROM spectra),
   g AS (SELECT *, bin - row_number() OVER (PARTITION BY frame_id, occ ORDER BY bin) AS isle FROM f), h AS (SELECT frame_id, count(*) AS w FROM g WHERE NOT occ GROUP BY frame_id, isle),
   k AS (SELECT frame_id, CAST(count(*) AS INTEGER) AS holes, max(w) * 1e5 AS largest FROM h GROUP BY 1)
   SELECT f.frame_id, 6.4e6::DOUBLE AS total_hz, count(*) FILTER (WHERE occ) * 1e5 AS occupied_hz, count(*) FILTER (WHERE occ) * 100.0::DOUBLE / 64 AS occupancy_percent, max(holes) AS holes, max(largest) AS largest_hole_hz
   FROM f JOIN k ON k.frame_id = f.frame_id GROUP BY 1""")
def _(spark, d):
    return V.psd_frames(spark, d).select("frame_id", S.band_occupancy("psd").alias("o")).select("frame_id", "o.*")


def run_sql(flag, src, order, last, extra="", keep_open=False):
    tail = "" if keep_open else f" WHERE last < {last}"
    return f"""WITH f AS (SELECT frame_id, {order} AS k, {flag} AS above FROM {src}), g AS (SELECT *, k - row_number() OVER (PARTITION BY frame_id ORDER BY k) AS isle FROM f WHERE above),
   r AS (SELECT frame_id, min(k) AS first, max(k) AS last FROM g GROUP BY frame_id, isle) SELECT {extra} FROM r{tail}"""


@query("o29_burst_detection", run_sql("p > quantile_cont(p, 0.25) OVER (PARTITION BY frame_id) * pow(10, 0.6)", "iq_power", "n", 31, "frame_id, first AS start, CAST(last + 1 AS INTEGER) AS stop") + " AND last - first + 1 >= 2")
def _(spark, d):
    return frames(spark, d).select("frame_id", F.inline(I.bursts(sample_rate=2000.0, min_duration_ms=1.0)))


@query("o30_envelope_bursts", run_sql("amp > avg(amp) OVER (PARTITION BY frame_id) + 2 * stddev_pop(amp) OVER (PARTITION BY frame_id)", "iq_power", "n", 31,
       "frame_id, CAST(count(*) AS INTEGER) AS burst_count, round(sum(last - first + 1) / 32.0::DOUBLE, 6) AS duty_cycle") + " GROUP BY 1")
def _(spark, d):
    b = frames(spark, d).select("frame_id", I.envelope_bursts().alias("b")).select("frame_id", "b.burst_count", "b.duty_cycle")
    return r6(b.filter("burst_count > 0"))


@query("o31_signal_regions", """WITH e AS (SELECT frame_id, n, sum(p) OVER (PARTITION BY frame_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS e FROM iq_power),
   f AS (SELECT frame_id, n AS k, e > quantile_cont(e, 0.25) OVER (PARTITION BY frame_id) * pow(10, 0.3) AS above FROM e), g AS (SELECT *, k - row_number() OVER (PARTITION BY frame_id ORDER BY k) AS isle FROM f WHERE above),
   r AS (SELECT frame_id, min(k) AS first, max(k) AS last FROM g GROUP BY frame_id, isle) SELECT frame_id, first AS start, CAST(last + 1 AS INTEGER) AS stop FROM r WHERE last < 31 AND last - first + 1 >= 2""")
def _(spark, d):
    return frames(spark, d).select("frame_id", F.inline(I.signal_regions()))


@query("o32_spectral_regions", run_sql("psd_db > quantile_cont(psd_db, 0.1) OVER (PARTITION BY frame_id) + 20", "spectra", "bin", 63, "frame_id, 2.4e9 + first * 1e5 AS start_hz, 2.4e9 + last * 1e5 AS stop_hz", True))
def _(spark, d):
    return V.psd_frames(spark, d).select("frame_id", F.inline(S.spectral_regions("psd", threshold_db=20.0))).select("frame_id", "start_hz", "stop_hz")


# -------------------------------------------------------------------- frame detection
SHAPE = """WITH nf AS (SELECT frame_id, median(psd_db) AS floor FROM spectra WHERE abs(bin * 5e5 - 16e6) >= 50000 GROUP BY 1),
   m AS (SELECT s.frame_id, bin, CASE WHEN abs(bin * 5e5 - 16e6) < 50000 THEN -999.0 ELSE psd_db END AS v, floor FROM spectra s JOIN nf ON nf.frame_id = s.frame_id),
   a AS (SELECT frame_id, bin, bin - lag(bin) OVER (PARTITION BY frame_id ORDER BY bin) AS gap FROM m WHERE v > floor + 6.0),
   g AS (SELECT *, sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id ORDER BY bin) AS grp FROM a),
   s AS (SELECT frame_id, min(bin) AS first, max(bin) AS last, count(*) AS hits FROM g GROUP BY frame_id, grp),
   b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY hits DESC, first) AS r FROM s) WHERE r = 1 AND hits >= 3 AND hits::DOUBLE / (last - first + 1) >= 0.5),
   c AS (SELECT m.frame_id, first, last, max(v) AS peak, avg(v) AS mean, avg(v) FILTER (WHERE bin < first + greatest(1, (last - first + 1) // 10)) AS le,
     avg(v) FILTER (WHERE bin > last - greatest(1, (last - first + 1) // 10)) AS re FROM m JOIN b ON b.frame_id = m.frame_id WHERE bin BETWEEN first AND last GROUP BY ALL),
   f AS (SELECT frame_id, round((2.4e9 + (first + last) / 2.0::DOUBLE * 5e5) / 1e6, 3) AS center_mhz, round(peak, 1) AS peak_db, round(peak - mean, 1) AS crest, round(least(peak - le, peak - re), 1) AS edge,
     round((last - first) * 5e5 / 1e6, 1) AS width, round(CASE WHEN last > first THEN least(peak - le, peak - re) / ((last - first) * 5e5 / 1e6 / 2) ELSE 0 END, 2) AS gradient FROM c)"""


def wide_frames(spark, d):
    return V.psd_frames(spark, d).withColumn("bin_hz", F.lit(5e5))


@query("o33_cluster_shape", SHAPE + " SELECT frame_id, center_mhz, peak_db, crest AS crest_factor_db, edge AS edge_drop_db, gradient AS gradient_db_per_mhz, width AS bandwidth_mhz FROM f")
def _(spark, d):
    w = wide_frames(spark, d)
    masked = S.mask_centre("psd", "f0_hz", "bin_hz", 2.416e9)
    shape = X.let(masked, lambda v: X.let(S.widest_cluster(v, S.floor_median("psd", centre_hz=2.416e9) + 6.0, F.lit(1)), lambda c: S.cluster_shape(v, c)))
    return w.select("frame_id", shape.alias("s")).filter("s is not null").select("frame_id", "s.*")


CLASSIFIED = SHAPE + """, k AS (SELECT *, CASE WHEN crest >= 7.0 AND edge >= 10.0 THEN 'Analog Video Link' WHEN crest < 5.0 AND edge < 8.0 AND width BETWEEN 10.0 AND 40.0 THEN 'Digital Video Link' END AS kind,
     CASE WHEN crest >= 7.0 AND edge >= 10.0 THEN round(least(0.95, 0.5 + (crest - 7.0) / 20.0 + (edge - 10.0) / 40.0), 3) WHEN crest < 5.0 AND edge < 8.0 AND width BETWEEN 10.0 AND 40.0
       THEN round(least(0.90, 0.5 + (5.0 - crest) / 20.0 + (8.0 - edge) / 40.0), 3) END AS conf FROM f),
   w AS (SELECT k.*, (SELECT min(ch) FROM (VALUES (2412),(2417),(2422),(2427),(2432),(2437),(2442),(2447),(2452),(2457),(2462),(2467),(2472),(2484)) x(ch) WHERE abs(center_mhz - ch) <= 3.0) AS ch FROM k WHERE kind IS NOT NULL)"""


@query("o34_video_link_classifier", CLASSIFIED + " SELECT frame_id, kind AS drone_type, conf AS confidence FROM k WHERE kind IS NOT NULL")
def _(spark, d):
    w = wide_frames(spark, d)
    masked = S.mask_centre("psd", "f0_hz", "bin_hz", 2.416e9)
    shape = X.let(masked, lambda v: X.let(S.widest_cluster(v, S.floor_median("psd", centre_hz=2.416e9) + 6.0, F.lit(1)), lambda c: S.cluster_shape(v, c)))
    return w.select("frame_id", S.classify_cluster(shape).alias("c")).filter("c is not null").select("frame_id", "c.*")


@query("o35_frame_detection", CLASSIFIED + """ SELECT frame_id, kind AS drone_type, CASE WHEN ch IS NOT NULL THEN round(conf * 0.5, 3) ELSE conf END AS confidence,
   CASE WHEN CASE WHEN ch IS NOT NULL THEN round(conf * 0.5, 3) ELSE conf END > 0.8 THEN 'high' WHEN CASE WHEN ch IS NOT NULL THEN round(conf * 0.5, 3) ELSE conf END > 0.6 THEN 'medium' ELSE 'low' END AS threat_level,
   center_mhz AS frequency_mhz, peak_db AS power_db, width AS bandwidth_mhz, ch IS NOT NULL AS wifi_channel_aligned, CAST(ch AS INTEGER) AS wifi_channel_mhz FROM w""")
def _(spark, d):
    out = S.detect_frames(wide_frames(spark, d), 2.416e9)
    return out.select("frame_id", "drone_type", "confidence", "threat_level", "frequency_mhz", "power_db", "bandwidth_mhz", "wifi_channel_aligned", "wifi_channel_mhz")


@query("d10_channel_band_power", """SELECT frame_id, '2.4GHz' AS band, round(sum(psd_db), 6) AS power FROM spectra WHERE freq_hz BETWEEN 2.4e9 AND 2.4835e9 GROUP BY 1""")
def _(spark, d):
    c = V.psd_frames(spark, d).select("frame_id", S.channel_analysis("psd").alias("c"))
    return r6(c.select("frame_id", F.explode("c.channel_power").alias("band", "power")))


@query("d11_wifi_alignment", """SELECT id, CAST((SELECT min(ch) FROM (VALUES (2412),(2417),(2422),(2427),(2432),(2437),(2442),(2447),(2452),(2457),(2462),(2467),(2472),(2484)) x(ch)
   WHERE abs(frequency / 1e6 - ch) <= 3.0) AS INTEGER) AS channel FROM detections""")
def _(spark, d):
    return V.detections(spark, d).select("id", S.wifi_channel(C("frequency") / 1e6).alias("channel"))


SIG = "SELECT CAST(p_partkey AS BIGINT) AS signature_id, (p_size * 1e5)::DOUBLE AS lo, (p_size * 1e5 + 4e5)::DOUBLE AS hi, 0.5 + (p_partkey % 50) / 200.0::DOUBLE AS mc FROM part"


def _signatures(spark, d):
    return table(spark, d, "part").select(C("p_partkey").alias("signature_id"), C("p_partkey").alias("position"), (C("p_size") * 1e5).alias("min_bandwidth"),
                                          (C("p_size") * 1e5 + 4e5).alias("max_bandwidth"), (0.5 + (C("p_partkey") % 50) / 200.0).alias("min_confidence"))


PEAK_SET = f"""WITH c AS (SELECT frame_id, list([bin] ORDER BY bin) AS cand FROM ({MAXIMA}) WHERE psd_db > 8 GROUP BY 1), e AS (SELECT c.*, embedding FROM c JOIN embeddings ON vec_id = frame_id),
   pk AS (SELECT frame_id, embedding, list_reduce(cand, lambda a, b: CASE WHEN b[1] - a[-1] >= 5 THEN list_concat(a, b) WHEN embedding[b[1]+1] > embedding[a[-1]+1] THEN list_concat(a[1:len(a)-1], b) ELSE a END) AS pks FROM e),
   sc AS (SELECT frame_id, CASE WHEN len(pks) < 2 THEN 0 ELSE (list_max(pks) - list_min(pks)) * 1e5 END AS bandwidth,
     (list_avg(list_transform(pks, lambda k: embedding[k+1]::DOUBLE * 100)) - list_min(embedding)::DOUBLE * 100) / (list_max(embedding)::DOUBLE * 100 - list_min(embedding)::DOUBLE * 100 + 1e-12) AS confidence FROM pk)"""


@query("d9_signature_bandwidth_match", PEAK_SET + f""", j AS (SELECT sc.frame_id, s.signature_id, row_number() OVER (PARTITION BY frame_id ORDER BY signature_id) AS r FROM sc JOIN ({SIG}) s
     ON bandwidth BETWEEN lo AND hi AND confidence >= mc) SELECT frame_id, signature_id FROM j WHERE r = 1""")
def _(spark, d):
    return S.match_signatures(V.psd_frames(spark, d), _signatures(spark, d), 8.0, 5).select("frame_id", "signature_id")


@query("d22_lagged_self_join", """WITH s AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS t FROM embeddings),
   x AS (SELECT label, t, generate_subscripts(embedding, 1) - 1 AS bin, unnest(embedding)::DOUBLE * 10 AS v FROM s)
   SELECT a.label, l.k AS lag, CAST(a.bin AS INTEGER) AS bin, round(sum(a.v * b.v), 6) AS correlation
   FROM (VALUES (0),(1),(2),(5)) l(k), x a JOIN x b ON a.label = b.label AND a.bin = b.bin WHERE b.t = a.t + l.k GROUP BY 1, 2, 3""")
def _(spark, d):
    s = table(spark, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("v"))
    t = ordered.row_numbers(s, "label", ["vec_id"], F.floor(C("vec_id") / 4096), "t")
    return r6(I.lagged_products_of_bins(t, "label", "t", "v", [0, 1, 2, 5], bins=64))


# ------------------------------------------------------------------------ interference
@query("o36_interference_detection")
def _(spark, d):
    return r6(V.psd_frames(spark, d).select("frame_id", F.inline(S.interference("psd"))))


HISTORY = """WITH h AS (SELECT label, frame_id, bin, floor(psd_db / 0.01 + 0.5) AS level FROM spectra),
   b AS (SELECT frame_id, bin, (median(level) OVER (PARTITION BY label, bin ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) * 0.01 AS baseline FROM h)"""


def _with_history(spark, d):
    f = V.psd_frames(spark, d)
    return B.history_median(f, "label", "frame_id", "psd", F.floor(C("frame_id") / 4096))


@query("o36_history_baseline", HISTORY + " SELECT frame_id, bin, round(baseline + 1e-10, 6) AS baseline FROM b")
def _(spark, d):
    rows = _with_history(spark, d).select("frame_id", F.posexplode("baseline").alias("bin", "baseline"))
    return rows.withColumn("baseline", F.round(C("baseline") + 1e-10, 6))


@query("o36_history_excess", HISTORY + """ SELECT s.frame_id, CAST(count(*) FILTER (WHERE psd_db - baseline > 10) AS BIGINT) AS bins_over, round(max(psd_db - baseline), 4) AS most
   FROM spectra s JOIN b USING (frame_id, bin) GROUP BY 1""")
def _(spark, d):
    over = F.zip_with("psd", "baseline", lambda x, b: x - b)
    return _with_history(spark, d).select("frame_id", F.size(F.filter(over, lambda x: x > 10)).cast("long").alias("bins_over"), F.round(F.array_max(over), 4).alias("most"))


@query("o36_history_interference")
def _(spark, d):
    found = S.interference("psd", baseline=lambda v: F.when(F.exists("baseline", lambda b: b.isNull()), K.moving_median(v)).otherwise(C("baseline")))
    return r6(_with_history(spark, d).select("frame_id", F.inline(found)))


@query("o37_interference_types")
def _(spark, d):
    found = V.psd_frames(spark, d).select("frame_id", F.inline(S.interference("psd")))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("severity"), 6).alias("mean_severity"))


@query("o38_interference_periodicity", """WITH h AS (SELECT label, bin, list(v ORDER BY vec_id) AS s FROM (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS bin, unnest(embedding)::DOUBLE * 100 AS v
     FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) r FROM embeddings) WHERE r <= 100) GROUP BY 1, 2),
   a AS (SELECT label, bin, len(s) AS n, list_transform(range(len(s)), lambda k: list_sum(list_transform(range(1, len(s) - k + 1), lambda t: s[t] * s[t + k]))) AS ac FROM h),
   p AS (SELECT label, bin, n, list_filter(range(2, n), lambda k: ac[k] > ac[k-1] AND ac[k] > ac[k+1] AND ac[k] >= 0.3 * list_max(ac)) AS pk FROM a)
   SELECT label, CAST(bin AS INTEGER) AS bin, round(CASE WHEN n >= 10 AND len(pk) > 1 THEN (pk[2] - pk[1]) / 10.0::DOUBLE END, 6) AS period_s FROM p""")
def _(spark, d):
    newest = S.waterfall(table(spark, d, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", 100)
    return r6(S.bin_periods(newest, "label", "vec_id", "embedding", scale=100.0).select("label", "bin", "period_s"))


@query("o39_channel_analysis", """SELECT frame_id, round(sum(psd_db), 6) AS total_power, round(max(psd_db), 6) AS peak_power, round(avg(psd_db), 6) AS average_power, round(quantile_cont(psd_db, 0.1), 6) AS noise_floor,
   sum(psd_db) > quantile_cont(psd_db, 0.1) * 64 * 10 AS interference_detected FROM spectra GROUP BY 1""")
def _(spark, d):
    c = V.psd_frames(spark, d).select("frame_id", S.channel_analysis("psd").alias("c")).select("frame_id", "c.*")
    return r6(c.select("frame_id", "total_power", "peak_power", "average_power", "noise_floor", "interference_detected"))


# -------------------------------------------------------------------------- modulation
LAG16 = """SELECT a.frame_id, sqrt(pow(sum(a.i*b.i + a.q*b.q), 2) + pow(sum(a.q*b.i - a.i*b.q), 2)) / sqrt(sum(a.p) * sum(b.p)) AS c FROM iq_power a JOIN iq_power b ON a.frame_id = b.frame_id AND b.n = a.n + 16 GROUP BY 1"""


@query("o40_modulation_rules", f"""WITH f AS (SELECT frame_id, var_pop(amp) / pow(avg(amp), 2) AS av, count(DISTINCT round(amp, 2)) AS levels FROM iq_power GROUP BY 1), s AS (SELECT frame_id, var_pop(raw) AS pv FROM iq_steps GROUP BY 1), l AS ({LAG16})
   SELECT f.frame_id, CASE WHEN av < 0.1 THEN CASE WHEN pv < 0.1 THEN 'GMSK' ELSE 'FM' END WHEN levels <= 2 THEN 'BPSK' WHEN levels <= 4 THEN 'QPSK' WHEN levels <= 16 THEN 'QAM16' WHEN levels <= 64 THEN 'QAM64'
     WHEN c > 0.3 THEN 'OFDM' ELSE 'UNKNOWN' END AS modulation FROM f JOIN s ON s.frame_id = f.frame_id JOIN l ON l.frame_id = f.frame_id""")
def _(spark, d):
    return frames(spark, d).select("frame_id", I.classify_modulation().alias("m")).select("frame_id", "m.modulation")


@query("o41_cyclic_prefix", f"SELECT frame_id, CASE WHEN c > 0.3 THEN 16 ELSE 0 END AS prefix FROM ({LAG16})")
def _(spark, d):
    return frames(spark, d).select("frame_id", I.cyclic_prefix().alias("prefix"))


@query("o42_symbol_rate", """WITH r AS (SELECT 2e3 + (2e5 - 2e3) * j / 19 AS rate, CAST(floor((2e3 + (2e5 - 2e3) * j / 19) * 32 / 2e6) AS INTEGER) AS a FROM range(20) t(j)),
   s AS (SELECT x.frame_id, r.rate, sqrt(pow(sum(x.re*y.re + x.im*y.im), 2) + pow(sum(x.im*y.re - x.re*y.im), 2)) / 32 AS m FROM dft x JOIN r ON r.a >= 1 JOIN dft y ON y.frame_id = x.frame_id AND y.bin = (x.bin - r.a + 32) % 32 GROUP BY 1, 2)
   SELECT e.vec_id AS frame_id, round(coalesce(median(s.rate), 0), 4) AS symbol_rate FROM embeddings e LEFT JOIN s ON s.frame_id = e.vec_id AND s.m > 0.1 GROUP BY 1""")
def _(spark, d):
    s = T.build_spectra(frames(spark, d), "hann")
    return rounded(T.symbol_rates(s, FS), 4)


@query("o43_carrier_offset", """WITH x AS (SELECT frame_id, n, (pow(i*i-q*q, 2) - pow(2*i*q, 2)) * 1e4 AS a, 2*(i*i-q*q)*2*i*q * 1e4 AS b FROM iq_samples),
   f AS (SELECT frame_id, k, pow(sum(a*cos(2*pi()*k*n/32) + b*sin(2*pi()*k*n/32)), 2) + pow(sum(b*cos(2*pi()*k*n/32) - a*sin(2*pi()*k*n/32)), 2) AS p FROM x, range(16) r(k) GROUP BY 1, 2)
   SELECT frame_id, arg_max(k, (round(p, 9), -k)) * 2e6 / 32 / 4 AS offset_hz FROM f GROUP BY 1""")
def _(spark, d):
    s = T.build_spectra(I.fourth_power(frames(spark, d)), "rect", i="i4", q="q4")
    return s.select("frame_id", I.carrier_offset(FS).alias("offset_hz"))


@query("o44_error_vector_magnitude", """WITH s AS (SELECT *, i / sqrt(avg(p) OVER w) AS a, q / sqrt(avg(p) OVER w) AS b FROM iq_power WINDOW w AS (PARTITION BY frame_id))
   SELECT frame_id, round(sqrt(avg(least(pow(a-1,2)+b*b, pow(a+1,2)+b*b))), 6) AS bpsk, round(sqrt(avg(pow(abs(a)-1/sqrt(2),2)+pow(abs(b)-1/sqrt(2),2))), 6) AS qpsk,
   round(sqrt(avg(least(pow(abs(a)-1/sqrt(10),2), pow(abs(a)-3/sqrt(10),2)) + least(pow(abs(b)-1/sqrt(10),2), pow(abs(b)-3/sqrt(10),2)))), 6) AS qam16 FROM s GROUP BY 1""")
def _(spark, d):
    return r6(frames(spark, d).select("frame_id", *[I.error_vector(k).alias(k.lower()) for k in ("BPSK", "QPSK", "QAM16")]))


@query("o45_doppler_shift", "SELECT frame_id, round(avg(dp) * 2e6 / (2*pi()) - 1000.0, 4) AS doppler_hz FROM iq_steps GROUP BY 1")
def _(spark, d):
    return rounded(frames(spark, d).select("frame_id", I.doppler_hz(FS, 1000.0).alias("doppler_hz")), 4)


@query("o46_multipath_delay", """WITH r AS (SELECT a.frame_id, b.n - a.n AS k, sum(a.i*b.i + a.q*b.q) AS r FROM iq_samples a JOIN iq_samples b ON a.frame_id = b.frame_id AND b.n >= a.n GROUP BY 1, 2)
   SELECT r.frame_id, coalesce(min(r.k) FILTER (WHERE r.r / z.r < 0.1), 0) / 2e6 AS delay_s FROM r JOIN r z ON z.frame_id = r.frame_id AND z.k = 0 GROUP BY 1""")
def _(spark, d):
    return T.multipath_delay(frames(spark, d), FS)


@query("o47_rf_fingerprint", """SELECT a.frame_id, round(s.sd, 6) AS phase_noise_std, round(s.mx, 6) AS phase_noise_max, round(20*log10(abs(avg(i)/(avg(q)+1e-12))), 4) AS imbalance_db,
   round(stddev_pop(amp)/avg(amp), 6) AS amplitude_variation, round(10*log10(avg(pow(p,3))/(avg(p)+1e-12)), 5) AS cubic_ratio_db, round(kurtosis_pop(amp), 6) AS amplitude_kurtosis, round(max(s.k), 6) AS phase_kurtosis
   FROM iq_power a JOIN (SELECT frame_id, stddev_pop(dp) AS sd, max(abs(dp)) AS mx, kurtosis_pop(dp) AS k FROM iq_steps GROUP BY 1) s ON s.frame_id = a.frame_id GROUP BY 1, s.sd, s.mx""")
def _(spark, d):
    f = frames(spark, d).select("frame_id", I.fingerprint().alias("f")).select("frame_id", "f.*")
    return f.select("frame_id", *[F.round(c, {"imbalance_db": 4, "cubic_ratio_db": 5}.get(c, 6)).alias(c) for c in f.columns if c != "frame_id"])


@query("o48_emitter_family", """SELECT frame_id, CASE WHEN stddev_pop(raw) > 0.5 AND stddev_pop(raw) < 2.0 THEN 'FPV' ELSE '' END AS family FROM iq_steps GROUP BY 1""")
def _(spark, d):
    return frames(spark, d).select("frame_id", I.emitter_family(F.lit(15e6)).alias("family"))


@query("o49_modulation_scores")
def _(spark, d):
    from aeroband.operators.detectors import score_frames
    return rounded(score_frames(frames(spark, d), FS))


@query("o50_signature_similarity", """WITH c AS (SELECT frame_id, sum(freq_hz * pow(10.0, psd_db/10)) / sum(pow(10.0, psd_db/10)) AS centroid, max(psd_db) AS top FROM spectra GROUP BY 1),
   s AS (SELECT n_nationkey AS sid, 2.4e9 + n_nationkey * 2.5e5 AS lo, 2.4e9 + n_nationkey * 2.5e5 + 1e6 AS hi, 10.0 + n_nationkey AS expected FROM nation),
   k AS (SELECT frame_id, sid, ((CASE WHEN centroid BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) + greatest(0, 1 - abs(top - expected) / (expected + 1e-12) / 0.5)) / 2 AS score FROM c, s),
   r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY round(score, 9) DESC, sid) AS rank FROM k)
   SELECT frame_id, CAST(sid AS INTEGER) AS signature_id, CAST(rank AS INTEGER) AS rank, round(score::DOUBLE, 6) AS score FROM r WHERE rank <= 3""")
def _(spark, d):
    from aeroband.operators.detectors import rank_signatures
    sig = table(spark, d, "nation").select(
        C("n_nationkey").alias("signature_id"), (2.4e9 + C("n_nationkey") * 2.5e5).alias("start_hz"), (2.4e9 + C("n_nationkey") * 2.5e5 + 1e6).alias("stop_hz"),
        (10.0 + C("n_nationkey")).alias("expected_peak"))
    return r6(rank_signatures(V.psd_frames(spark, d), sig).select("frame_id", "signature_id", "rank", "score"))


@query("o51_signature_confidence", PEAK_SET + " SELECT frame_id, round(confidence, 6) AS confidence FROM sc")
def _(spark, d):
    c = S.signature_confidence("psd", lambda v: K.detect(v, 8.0, 5))
    return r6(V.psd_frames(spark, d).select("frame_id", c.alias("confidence")).filter("confidence > 0"))


@query("o52_basic_features", PEAK_SET + """ SELECT s.frame_id, coalesce(len(any_value(pks)), 0)::DOUBLE AS peak_count, round(avg(psd_db), 6) AS mean_power, round(max(psd_db), 6) AS max_power, round(var_pop(psd_db), 6) AS power_variance
   FROM spectra s LEFT JOIN pk ON pk.frame_id = s.frame_id GROUP BY 1""")
def _(spark, d):
    f = V.psd_frames(spark, d).select("frame_id", S.basic_features("psd", 8.0, 5).alias("f")).select("frame_id", "f.*")
    return r6(f.drop("peak_mean_power", "peak_max_power"))


def _welch_frames(spark, d):
    w = T.welch(frames(spark, d), FS, 32, 0.5)
    return w.withColumn("f0_hz", F.lit(-FS / 2)).withColumn("bin_hz", F.lit(FS / 32))


@query("o53_spectral_features", f"""WITH p AS (SELECT frame_id, bin, (bin - 16) * 62500.0 AS f, (re*re+im*im) / (2e6 * {SW2}) AS p FROM dft), g AS (SELECT *, 10*log10(p + 1e-12) AS db, max(10*log10(p + 1e-12)) OVER (PARTITION BY frame_id) AS top FROM p),
   c AS (SELECT frame_id, sum(f*p)/sum(p) AS cen FROM p GROUP BY 1)
   SELECT g.frame_id, round(avg(db), 4) AS power_spectral_density_mean, round(stddev_pop(db), 4) AS power_spectral_density_std, count(*) FILTER (WHERE db > top - 3) * 62500.0::DOUBLE AS bandwidth_3db,
     count(*) FILTER (WHERE db > top - 20) * 62500.0::DOUBLE AS bandwidth_20db, round(exp(avg(ln(p + 1e-12))) / avg(p), 6) AS spectral_flatness, round(any_value(cen), 2) AS spectral_centroid,
     round(sqrt(sum(pow(f - cen, 2) * p) / sum(p)), 2) AS spectral_spread FROM g JOIN c ON c.frame_id = g.frame_id GROUP BY 1""")
def _(spark, d):
    f = _welch_frames(spark, d).select("frame_id", S.spectral_features("psd").alias("f")).select("frame_id", "f.*")
    digits = {"power_spectral_density_mean": 4, "power_spectral_density_std": 4, "spectral_centroid": 2, "spectral_spread": 2}
    return f.select("frame_id", *[F.round(c, digits.get(c, 6)).alias(c) for c in ("power_spectral_density_mean", "power_spectral_density_std", "bandwidth_3db", "bandwidth_20db",
                                                                                 "spectral_flatness", "spectral_centroid", "spectral_spread")])


@query("o54_cyclic_features", """WITH r AS (SELECT 1e6 / 19 * j AS alpha, CAST(floor(1e6 / 19 * j * 32 / 2e6) AS INTEGER) AS a FROM range(1, 20) t(j)),
   s AS (SELECT x.frame_id, r.alpha, sqrt(pow(sum(x.re*y.re + x.im*y.im), 2) + pow(sum(x.im*y.re - x.re*y.im), 2)) / 32 AS m FROM dft x JOIN r ON r.a >= 1 JOIN dft y ON y.frame_id = x.frame_id AND y.bin = (x.bin - r.a + 32) % 32 GROUP BY 1, 2)
   SELECT frame_id, round(max(m), 6) AS cyclic_coherence, round(1e6 / 19, 4) AS cycle_frequency_spacing FROM s GROUP BY 1""")
def _(spark, d):
    s = T.build_spectra(frames(spark, d), "hann").select("frame_id", S.cyclic_features(FS).alias("c"))
    return s.select("frame_id", F.round("c.cyclic_coherence", 6).alias("cyclic_coherence"), F.round("c.cycle_frequency_spacing", 4).alias("cycle_frequency_spacing"))


@query("o55_statistical_features", """SELECT a.frame_id, round(avg(i),6) AS iq_mean_real, round(avg(q),6) AS iq_mean_imag, round(stddev_pop(i),6) AS iq_std_real, round(stddev_pop(q),6) AS iq_std_imag, round(var_pop(i)+var_pop(q),6) AS iq_variance,
   round(kurtosis_pop(i),6) AS iq_kurtosis, round(var_pop(amp),6) AS amplitude_variance, round(var_pop(ph),6) AS phase_variance, round(any_value(s.sd),6) AS instantaneous_frequency_std
   FROM iq_power a JOIN (SELECT frame_id, stddev_pop(raw) AS sd FROM iq_steps GROUP BY 1) s ON s.frame_id = a.frame_id GROUP BY 1""")
def _(spark, d):
    return struct_rows(frames(spark, d).select("frame_id", S.statistical_features().alias("f")), "f", "frame_id").drop("iq_skewness")


@query("o56_modulation_features", """WITH s AS (SELECT *, i / sqrt(avg(p) OVER w) AS a, q / sqrt(avg(p) OVER w) AS b FROM iq_power WINDOW w AS (PARTITION BY frame_id)),
   e AS (SELECT *, sqrt(pow(a - CASE WHEN n % 4 < 2 THEN 1 ELSE -1 END / sqrt(2), 2) + pow(b - CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END / sqrt(2), 2)) AS er FROM s)
   SELECT e.frame_id, round(sqrt(avg(er*er)),6) AS evm_rms, round(max(er),6) AS evm_peak, round(stddev_pop(atan2(b, a)),6) AS phase_error_rms, round(stddev_pop(sqrt(a*a+b*b)),6) AS magnitude_error_rms,
     round(any_value(sd), 2) AS frequency_deviation FROM e JOIN (SELECT frame_id, stddev_pop(dp) * 2e6 / (2*pi()) AS sd FROM iq_steps GROUP BY 1) t ON t.frame_id = e.frame_id GROUP BY 1""")
def _(spark, d):
    f = frames(spark, d).select("frame_id", S.modulation_features(FS, F.lit(0.0), F.lit(0.0)).alias("f")).select("frame_id", "f.*")
    return f.select("frame_id", *[F.round(c, 2 if c == "frequency_deviation" else 6).alias(c) for c in ("evm_rms", "evm_peak", "phase_error_rms", "magnitude_error_rms", "frequency_deviation")])


@query("o57_documented_extras", """WITH p AS (SELECT frame_id, re*re+im*im AS p FROM dft), e AS (SELECT frame_id, p, sum(p + 1e-12) OVER (PARTITION BY frame_id) AS t FROM p),
   k AS (SELECT frame_id, sqrt(pow(avg(i*i-q*q),2)+pow(avg(2*i*q),2)) AS c20, avg(p) AS c21, max(abs(amp - lamp)) / avg(amp) AS gamma_max FROM (SELECT *, lag(amp) OVER (PARTITION BY frame_id ORDER BY n) AS lamp FROM iq_power) GROUP BY 1)
   SELECT e.frame_id, round(-sum((p + 1e-12) / t * ln((p + 1e-12) / t)), 6) AS entropy, round(any_value(c20), 6) AS c20, round(any_value(c21), 6) AS c21, round(any_value(gamma_max), 6) AS gamma_max
   FROM e JOIN k ON k.frame_id = e.frame_id GROUP BY 1""")
def _(spark, d):
    s = T.build_spectra(frames(spark, d), "hann", keep=("frame_id", "i", "q")).withColumn("bin_hz", F.lit(62500.0))
    f = s.select("frame_id", S.documented_extras(T.power_spectrum()).alias("x"), I.cumulants().alias("c"), I.modulation_extras(FS).alias("m"))
    return r6(f.select("frame_id", "x.entropy", "c.c20", "c.c21", "m.gamma_max"))


@query("o58_linear_resample", """WITH g AS (SELECT vec_id AS frame_id, CAST(k AS INTEGER) AS n, k * 2e6 / 1.5e6 AS t FROM embeddings, range(24) r(k))
   SELECT g.frame_id, g.n, round(a.i + (b.i - a.i) * (t - floor(t)), 6) AS i, round(a.q + (b.q - a.q) * (t - floor(t)), 6) AS q FROM g JOIN iq_samples a ON a.frame_id = g.frame_id AND a.n = floor(t)
   JOIN iq_samples b ON b.frame_id = g.frame_id AND b.n = least(floor(t) + 1, 31)""")
def _(spark, d):
    return long_iq(I.resample_linear(frames(spark, d), 2e6, 1.5e6))


@query("o59_triggered_capture", """WITH k AS (SELECT emitter, list([[epoch_us(ts), id]] ORDER BY ts, id) AS v FROM detections WHERE confidence > 0.85 GROUP BY 1),
   f AS (SELECT emitter, unnest(list_reduce(v, lambda a, b: CASE WHEN b[1][1] - a[-1][1] >= 36000000000 THEN list_concat(a, b) ELSE a END)) AS x FROM k),
   t AS (SELECT CAST(x[2] AS BIGINT) AS trigger_id, emitter, make_timestamp(CAST(x[1] AS BIGINT)) AS ts FROM f)
   SELECT t.trigger_id, d.id FROM t JOIN detections d ON d.emitter = t.emitter AND d.ts BETWEEN t.ts - INTERVAL 2 HOUR AND t.ts + INTERVAL 4 HOUR""")
def _(spark, d):
    from aeroband.operators.detectors import triggered_capture
    det = V.detections(spark, d).select("id", "emitter", "ts", "confidence")
    return triggered_capture(det, C("confidence") > 0.85, ["emitter"], before_s=7200, after_s=14400, spacing_s=36000).select("trigger_id", "id")


@query("o61_window_statistics", """SELECT frame_id, round(max(psd_db),6) AS peak, round(min(psd_db),6) AS floor, round(avg(psd_db),6) AS average, round(max(psd_db)-min(psd_db),6) AS dynamic_range,
   CAST((SELECT count(DISTINCT emitter) FROM detections WHERE frequency BETWEEN 2.4e9 AND 2.4063e9) AS BIGINT) AS emitters FROM spectra GROUP BY 1""")
def _(spark, d):
    inside = V.detections(spark, d).filter(C("frequency").between(2.4e9, 2.4063e9)).select(F.countDistinct("emitter"))
    f = V.psd_frames(spark, d).select("frame_id", S.window_statistics("psd").alias("w")).select("frame_id", "w.*").drop("start_hz", "stop_hz")
    return r6(f.withColumn("emitters", inside.scalar()))


@query("o62_waterfall_history", "SELECT label, vec_id AS frame_id, CAST(r AS INTEGER) AS age FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) r FROM embeddings) WHERE r <= 100")
def _(spark, d):
    return S.waterfall(V.psd_frames(spark, d).select("label", "frame_id"), "label", "frame_id", 100)


@query("o63_best_gain", """WITH h AS (SELECT frame_id, label, p, row_number() OVER (PARTITION BY frame_id ORDER BY p) AS r, avg(p) OVER (PARTITION BY frame_id) AS mean FROM iq_power),
   s AS (SELECT frame_id, label, 10*log10(max(mean) / median(p)) AS snr FROM h WHERE r <= 16 GROUP BY 1, 2), g AS (SELECT label, frame_id % 10 * 5 AS gain, avg(snr) AS snr FROM s GROUP BY 1, 2)
   SELECT label, arg_max(gain, (round(snr, 9), -gain)) AS best_gain, round(max(snr), 6) AS snr FROM g GROUP BY 1""")
def _(spark, d):
    from aeroband.operators.detectors import best_gain
    f = frames(spark, d).withColumn("gain", C("frame_id") % 10 * 5)
    return r6(best_gain(f, "label", "gain"))


@query("o64_energy_duty_cycle", "SELECT frame_id, round(avg(CASE WHEN db > t THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS duty_cycle FROM (SELECT frame_id, 10*log10(p+1e-12) AS db, quantile_cont(10*log10(p+1e-12), 0.25) OVER (PARTITION BY frame_id) + 6 AS t FROM iq_power) GROUP BY 1")
def _(spark, d):
    return r6(frames(spark, d).select("frame_id", I.duty_cycle().alias("duty_cycle")))


@query("o65_percentile_snr", "SELECT frame_id, round(quantile_cont(10*log10(p+1e-12), 0.9) - quantile_cont(10*log10(p+1e-12), 0.1), 6) AS snr_db FROM iq_power GROUP BY 1")
def _(spark, d):
    return r6(frames(spark, d).select("frame_id", I.percentile_snr_db().alias("snr_db")))


@query("o66_covariance_imbalance", """SELECT x.frame_id, n, round(i / si, 6) AS i, round((q + c / (si * sq) * i) / sq, 6) AS q FROM iq_samples x
   JOIN (SELECT frame_id, stddev_pop(i) AS si, stddev_pop(q) AS sq, avg(i*q) AS c FROM iq_samples GROUP BY 1) s ON s.frame_id = x.frame_id""")
def _(spark, d):
    return long_iq(I.correct_imbalance_covariance(frames(spark, d)))


@query("o67_reference_evm", "SELECT frame_id, round(sqrt(avg(pow(i - round(i, 1), 2) + pow(q - round(q, 1), 2)) / avg(pow(round(i, 1), 2) + pow(round(q, 1), 2))) * 100, 4) AS evm_percent FROM iq_samples GROUP BY 1")
def _(spark, d):
    s = V.iq_samples(spark, d).select("frame_id", "n", "i", "q")
    ref = s.select("frame_id", "n", F.round("i", 1).alias("i"), F.round("q", 1).alias("q"))
    return rounded(I.reference_error_percent(s, ref), 4)


@query("o68_twenty_db_bandwidth", """WITH t AS (SELECT *, max(psd_db) OVER (PARTITION BY frame_id) - 20 AS t FROM spectra) SELECT frame_id, (max(bin) - min(bin)) * 1e5 AS measured_hz,
   abs((max(bin) - min(bin)) * 1e5 - 5e6) < 5e5 AS valid FROM t WHERE psd_db > t GROUP BY 1""")
def _(spark, d):
    return V.psd_frames(spark, d).select("frame_id", S.twenty_db_bandwidth("psd", 5e6).alias("b")).select("frame_id", "b.measured_hz", "b.valid")
