"""Plain words for measured features, and names of synthesis tools in embedded tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the named features mean.
MEANING = {
    "flatness_mean": "spectral flatness (how noise-like the spectrum is)",
    "flatness_std": "variation of spectral flatness over time",
    "hi_flatness_mean": "flatness of the 4-7 kHz band (vocoder noise shaping)",
    "centroid_mean": "spectral centroid (brightness)",
    "centroid_std": "variation of brightness over time",
    "rolloff95_mean": "frequency below which 95% of the energy lies",
    "energy_range_db": "loudness dynamic range between speech and pauses",
    "pause_ratio": "fraction of frames that are pauses or near-silence",
    "frame_energy_std": "frame-to-frame loudness variation",
    "dc_offset": "DC offset of the waveform",
    "crest_factor_db": "peak-to-RMS ratio",
    "clip_ratio": "fraction of clipped samples",
    "zcr_mean": "zero-crossing rate (fricative and noise content)",
    "zcr_std": "variation of the zero-crossing rate",
    "spectral_flux_mean": "average frame-to-frame spectral change",
    "spectral_flux_std": "burstiness of frame-to-frame spectral change",
    "duration_s": "clip duration",
    "lead_silence_s": "leading silence",
    "trail_silence_s": "trailing silence",
}
#: What the numbered features mean, by the pattern of their names, with places for its parts.
CEPSTRAL = {("", "mean"): "average of %s", ("", "std"): "variation over time of %s", ("d", "std"): "frame-to-frame jitter of %s"}
COEFFICIENT = "cepstral coefficient %s (spectral envelope detail)"
BAND = {"mean": "share of energy in the %s-%s Hz band", "std": "variability of energy in the %s-%s Hz band"}
#: Names of speech synthesis tools, and the one that names too many other things to count.
SYNTH_TOOLS = (
    "elevenlabs", "play.ht", "playht", "coqui", "xtts", "tortoise", "bark", "openvoice", "tacotron", "fastspeech", "vits", "espnet", "resemble",
    "murf", "wellsaid", "polly", "wavenet", "text-to-speech", "tts", "voicebox", "speechify", "descript", "rvc", "so-vits",
)
NO_EVIDENCE = "tts"
#: Tags that come from the file system and say nothing about the content.
FILE_TAGS = ("SourceFile", "FileName", "Directory", "FileSize", "FileModifyDate", "FileAccessDate", "FileInodeChangeDate", "FilePermissions", "FileType", "FileTypeExtension", "MIMEType", "ExifToolVersion")


def describe_feature(name: Column) -> Column:
    """The meaning of a feature's name; a name that isn't known stands for itself."""
    cepstral, band = r"^(d?)lfcc(\d+)_(mean|std)$", r"^band_(\d+)_(\d+)_(mean|std)$"
    part = lambda pattern, i: F.regexp_extract(name, pattern, i)
    known = F.create_map(*(F.lit(x) for item in MEANING.items() for x in item))
    coefficient = F.format_string(COEFFICIENT, part(cepstral, 2))
    made = [F.when((part(cepstral, 1) == d) & (part(cepstral, 3) == stat), F.format_string(words, coefficient)) for (d, stat), words in CEPSTRAL.items()]
    made += [F.when(part(band, 3) == stat, F.format_string(words, part(band, 1), part(band, 2))) for stat, words in BAND.items()]
    return F.coalesce(F.try_element_at(known, name), *made, name)


def synth_tools(tags: Column) -> Column:
    """Sorted names of tools that begin a word of the values of a map of embedded tags."""
    own = F.map_filter(tags, lambda k, v: ~k.isin(*FILE_TAGS) & v.isNotNull())
    text = F.concat(F.lit(" "), F.lower(F.array_join(F.map_values(own), " ")))
    return F.array_sort(F.filter(F.array(*map(F.lit, SYNTH_TOOLS)), lambda t: (t != NO_EVIDENCE) & F.contains(text, F.concat(F.lit(" "), t))))
