import pytest

from ridgeline.__main__ import main
from ridgeline.config import Settings, overridden, read_settings


def test_overrides():
    assert overridden(Settings(), {"gap_hours": 6}).gap_hours == 6
    with pytest.raises(KeyError):
        overridden(Settings(), {"gap": 6})
    for bad in ({"gap_hours": 0}, {"gap_hours": 721}, {"trip_max_days": 31}, {"jump_km": "far"}, {"near_bits": True}, {"jump_km": float("nan")}):
        with pytest.raises(ValueError):
            overridden(Settings(), bad)


def test_files(tmp_path):
    path = tmp_path / "settings.toml"
    path.write_bytes(b"\xef\xbb\xbfgap_hours = 6.5\n")
    assert read_settings(path) == overridden(Settings(), {"gap_hours": 6.5})
    assert read_settings(tmp_path / "none.toml") == read_settings(None) == Settings()


def test_wrong_use(capsys):
    assert main([]) == 2 and main(["no_such_query", "x"]) == 2
    assert "p7_found" in capsys.readouterr().err
