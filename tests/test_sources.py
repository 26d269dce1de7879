"""Trial files of both variants, configuration files, and the sinks."""

import pytest
from pyspark.sql import functions as F

from saunter.operators import grid
from saunter.operators import normalize as N
from saunter.sources import grids, trials
from saunter.sources.schema import schema

SURFACE = "n_walkers,n_volume,mu,lmax,D,surface,TargetShape,n_targets,fixed_target_dist,detection_time,probability,surface_selector,first_touch_steps,second_touch_steps,delta_selector,delta"
VOLUME = "n_walkers,n_volume,mu,lmax,D,TargetShape,DiskDiameter,n_targets,fixed_target_dist,detection_time,probability"
ROW1 = "1,134217728,1.2,256,10.36,480.00,Ball,1,0.0,123.45,1.00,1,7,-1,0,0.00"
ROW2 = "1,134217728,2.0,256,5.24,Ball_no_boundary,10,1,0.0,99.10,1.00"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text(f"{SURFACE}\n{ROW1}\n{ROW1}\n")
    (tmp_path / "b.csv").write_text(f"{VOLUME}\n{ROW2}\n")
    (tmp_path / "c.csv").write_text(f"{SURFACE}\n{ROW1}\n{ROW1}\n")
    (tmp_path / "nested").mkdir()
    return tmp_path


def test_variants_are_matched_by_name(spark, folder):
    got = trials.read_trials(spark, f"{folder}/*.csv")
    assert got.count() == 5
    ball = got.where("TargetShape = 'Ball_no_boundary'").first()
    assert ball["DiskDiameter"] == 10 and ball["surface"] is None and ball["detection_time"] == 99.1
    assert got.where("TargetShape = 'Ball'").first()["surface"] == 480


def test_equal_files_can_be_read_once(spark, folder):
    assert trials.read_trials(spark, f"{folder}/*.csv", dedupe_files=True).count() == 3


def test_no_files_with_a_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    assert trials.read_trials(spark, str(tmp_path)).count() == 0


def test_single_file_and_required_columns(spark, folder):
    one = trials.read_trial_file(spark, f"{folder}/b.csv", "fixed_volume")
    assert one.schema == schema("fixed_volume") or one.columns == schema("fixed_volume").names
    assert trials.read_trial_file(spark, f"{folder}/b.csv").first()["mu"] == 2.0
    with pytest.raises(ValueError, match="delta.*surface"):
        trials.require_columns(one, ["mu", "surface", "delta"])


def test_sink_round_trip(spark, folder, tmp_path):
    read = trials.read_trials(spark, f"{folder}/a.csv")
    trials.write_trials(read, str(tmp_path / "out"))
    lines = [x for p in (tmp_path / "out").glob("part-*.csv") for x in p.read_text().splitlines()]
    assert set(lines) == {SURFACE, ROW1} and lines.count(ROW1) == 2
    trials.write_store(read, str(tmp_path / "store"))
    assert (tmp_path / "store" / "TargetShape=Ball" / "mu=1.2").exists()


def test_ratio_matrix_file(spark, tmp_path):
    long = spark.createDataFrame([(0.0, 1.0, 0.5), (0.0, 2.0, 1.0), (0.1, 1.0, 0.25)], "delta double, mu double, ratio double")
    trials.write_ratio_matrix(N.ratio_matrix(long, [1.0, 2.0]), str(tmp_path / "wide"))
    text = next((tmp_path / "wide").glob("part-*.csv")).read_text().splitlines()
    assert text[:2] == ["delta,mu_1.0,mu_2.0", "0.00000000,0.50000000,1.00000000"] and text[2].startswith("0.10000000,0.25000000,")


#: Own levels. By hand: 3 mu x 2 shapes x 4 surfaces x 2 delta = 48 cells. On side 256 a surface of 250000 gives a
#: diameter of 280.1 (Ball) or 700.8 (Disk): too large; all other diameters lie between 1.5 and 103.5.
OWN_CONFIG = """# a comment

surface_selector=1
delta_selector=0
num_runs=25
rangemu_LevyDistrib=1.0,1.5,2.5
range_diam=40,400,6000,250000
range_side=256
l_max=128
range_delta=0.25,0.75
list_shapes=Ball,Disk
range_nwalkers=2
range_ntargets=1
range_probability=0.5
other=1
file_name=own.csv"""


def test_grids(spark, tmp_path):
    (tmp_path / "own.conf").write_text(OWN_CONFIG)
    blank = OWN_CONFIG.replace("Ball,Disk", "Disk, ").replace("range_diam=40,", "range_diam=")
    (tmp_path / "blank.conf").write_text(blank + "\nnum_runs=40")
    cells = grid.surface_cells(grids.read_grids(spark, str(tmp_path)))
    got = {r["experiment"].rsplit("/", 1)[1]: (r["cells"], r["valid"], r["expected_rows"]) for r in grid.cell_counts(cells).collect()}
    assert got == {"own.conf": (48, 36, 900), "blank.conf": (36, 12, 480)}
    dropped = cells.where(~grid.is_valid()).where("experiment like '%own.conf'").select("TargetShape", "surface").distinct().collect()
    assert sorted(map(tuple, dropped)) == [("Ball", 250000.0), ("Disk", 250000.0)]
    ids = [r["cell_id"] for r in cells.where("experiment like '%own.conf'").collect()]
    assert sorted(ids) == list(range(48))
    assert grid.expand_grid(grid.valid_cells(cells).where("experiment like '%own.conf'").limit(3)).count() == 75


def test_unknown_header_is_an_error(spark, folder):
    (folder / "d.csv").write_text("one,two\n1,2\n")
    with pytest.raises(ValueError, match="d.csv"):
        trials.read_trials(spark, f"{folder}/*.csv")


def test_last_value_wins(spark, tmp_path):
    (tmp_path / "x.conf").write_text("num_runs=3\nnum_runs=  5\n#num_runs=7\nx\nlist_shapes=Ball")
    row = grids.read_grids(spark, str(tmp_path)).first()
    assert row["num_runs"] == 5 and row["list_shapes"] == ["Ball"] and row["range_side"] is None


def test_fixed_volume_grid(spark):
    row = [([512], [1.0, 2.0], [10.0, 100.0], [1], [1], ["Disk", "Ball_no_boundary", "Line"], "Disk", 200, 0)]
    kinds = "range_side array<int>, rangemu_LevyDistrib array<double>, range_disk_diameter array<double>, range_ntargets array<int>, range_nwalkers array<int>, list_shapes array<string>, reference_shape string, num_runs int, delta_selector int"
    cells = grid.volume_cells(spark.createDataFrame(row, kinds))
    assert cells.count() == 8 and {r["lmax"] for r in cells.collect()} == {256}
    assert cells.where("TargetShape = 'Ball_no_boundary' and DiskDiameter = 10").select(F.round("D", 4)).first()[0] == 5.2415


def test_coverage_of_configurations_of_both_variants(spark, folder):
    common = "num_runs=4\nrange_side=512\nrangemu_LevyDistrib=1.2,2.0\nrange_nwalkers=1\nrange_ntargets=1\n"
    (folder / "confs").mkdir()
    (folder / "confs" / "s.conf").write_text(common + "surface_selector=1\ndelta_selector=0\nl_max=256\nrange_diam=480,3\nlist_shapes=Ball\nrange_probability=1.0\n")
    (folder / "confs" / "v.conf").write_text(common + "reference_shape=Disk\nrange_disk_diameter=10\nlist_shapes=Disk,Ball_no_boundary,Line\n")
    found = grid.config_coverage(grids.read_grids(spark, f"{folder}/confs"), trials.read_trials(spark, f"{folder}/a.csv", f"{folder}/b.csv"))
    got = sorted((r["variant"], r["mu"], r["TargetShape"], r["expected"], r["actual"], r["missing"], r["pct"]) for r in found.collect())
    assert got == [("fixed_volume", 1.2, "Ball_no_boundary", 4, 0, 4, 0.0), ("fixed_volume", 1.2, "Disk", 4, 0, 4, 0.0), ("fixed_volume", 2.0, "Ball_no_boundary", 4, 1, 3, 25.0),
                   ("fixed_volume", 2.0, "Disk", 4, 0, 4, 0.0), ("surface", 1.2, "Ball", 4, 2, 2, 50.0), ("surface", 2.0, "Ball", 4, 0, 4, 0.0)]
