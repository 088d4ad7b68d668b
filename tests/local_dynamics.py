"""Axis dynamics of a record in memory, to hold the distributed ones against."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def axis_dynamics(samples: DataFrame, centres: DataFrame, rate: float, least: int = 2, rec: str = "rec", order: str = "pos", map_: str = "map", state: str = "k") -> DataFrame:
    """How the samples of each record and state move about the state's axis: projections, angles, energy, principal components of the residual and its precession.

    A record's samples (rec, pos, map, k) go through one Python call, as singular
    vectors and phases need them together. Centres (k, centre) are a model's states.
    """
    axes = {r["k"]: np.asarray(r["centre"], float) for r in centres.collect()}  # a model has some tens of states at most
    if len(axes) > 1000:
        raise ValueError("too many states for one model")
    metrics = "projection_rms projection_sd projection_mean_abs zero_crossing_hz energy_fraction pc1_pct pc2_pct pc1_axis_corr angle_mean_deg angle_sd_deg angle_median_deg perpendicular_fraction residual_pc1_pct residual_pc2_pct phase_resultant precession_deg_s precession_abs_deg_s precession_median_deg_s abs_cycles_s net_cycles_s directionality positive_fraction negative_fraction".split()

    def normal(x: np.ndarray) -> np.ndarray:
        x = x - x.mean(axis=-1, keepdims=True)
        n = np.linalg.norm(x, axis=-1, keepdims=True)
        return x / np.where(n <= 1e-12, 1.0, n)

    def components(x: np.ndarray, axis: np.ndarray) -> tuple[float, float, float, np.ndarray | None]:
        if len(x) < 2:
            return math.nan, math.nan, math.nan, None
        _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        latent = s**2 / (len(x) - 1)
        if latent.sum() <= 1e-15:
            return math.nan, math.nan, math.nan, None
        return 100 * latent[0] / latent.sum(), 100 * latent[1] / latent.sum() if len(latent) > 1 else math.nan, abs(v[0] @ axis), v.T

    def of_record(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        raw, labels = np.stack(pdf[map_].to_numpy()).astype(float), pdf[state].to_numpy()
        unit, out = normal(raw), []
        for k in sorted(axes):
            axis, on = normal(axes[k]), labels == k
            at = np.flatnonzero(on)
            row = dict.fromkeys(metrics, math.nan)
            if len(at) >= max(2, least):
                seconds, next_to = len(at) / rate, np.diff(at) == 1
                signal, proj = raw @ axis, np.clip(unit @ axis, -1, 1)
                a, b = signal[at[:-1]], signal[at[1:]]
                angles = np.degrees(np.arccos(np.abs(proj[on])))
                row.update(projection_rms=np.sqrt((signal[on] ** 2).mean()), projection_sd=signal[on].std(ddof=1), projection_mean_abs=np.abs(signal[on]).mean(), zero_crossing_hz=((a * b < 0) & next_to).sum() / seconds, energy_fraction=(proj[on] ** 2).mean(), angle_mean_deg=angles.mean(), angle_sd_deg=angles.std(ddof=1), angle_median_deg=np.median(angles), perpendicular_fraction=(1 - proj[on] ** 2).mean())
                row["pc1_pct"], row["pc2_pct"], row["pc1_axis_corr"], _ = components(unit[on], axis)
                rest = unit * np.where(proj < 0, -1.0, 1.0)[:, None] - np.abs(proj)[:, None] * axis
                row["residual_pc1_pct"], row["residual_pc2_pct"], _, basis = components(rest[on], axis)
                if basis is not None and basis.shape[1] >= 2:
                    phase_ = np.arctan2(rest @ basis[:, 1], rest @ basis[:, 0])
                    row["phase_resultant"] = abs(np.exp(1j * phase_[on]).mean())
                    turn = np.angle(np.exp(1j * (phase_[at[1:]] - phase_[at[:-1]])))[next_to]
                    if len(turn):
                        deg = rate * 180 / np.pi
                        row.update(precession_deg_s=turn.mean() * deg, precession_abs_deg_s=np.abs(turn).mean() * deg, precession_median_deg_s=np.median(np.abs(turn)) * deg, abs_cycles_s=np.abs(turn).sum() / (2 * np.pi) / seconds, net_cycles_s=turn.sum() / (2 * np.pi) / seconds, directionality=abs(turn.sum()) / max(np.abs(turn).sum(), 1e-15), positive_fraction=(turn > 0).mean(), negative_fraction=(turn < 0).mean())
            starts = len(at) and 1 + int((np.diff(at) > 1).sum())
            out.append({rec: pdf[rec].iloc[0], state: k, "n_samples": len(pdf), "n_active": len(at), "active_fraction": len(at) / len(pdf), "n_runs": starts, **row})
        return pd.DataFrame(out)

    kinds = f"{rec} {samples.schema[rec].dataType.simpleString()}, {state} {samples.schema[state].dataType.simpleString()}, n_samples long, n_active long, active_fraction double, n_runs long, " + ", ".join(f"{m} double" for m in metrics)
    return samples.select(rec, order, map_, state).groupBy(rec).applyInPandas(of_record, kinds)
