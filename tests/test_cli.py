from gaugeworks.__main__ import main
from test_building import CHAIN, model


def test_building_run_writes_a_recommendation_and_a_drawing(spark, tmp_path):
    (tmp_path / "house.ifc").write_text(model(*CHAIN))
    main(["--bim", str(tmp_path / "house.ifc"), "--out", str(tmp_path / "out"), "--hours", "2", "--iterations", "1"])
    text = (tmp_path / "out/recommendation.md").read_text()
    assert "5 elements, 2 zones, 0 equipment, 3 sensors" in text and "| occupancy | 1 | 365 |" in text and "100%" in text
    drawing = (tmp_path / "out/schematic.svg").read_text()
    assert drawing.count("<circle") == 3 and "Floor 3" in drawing
