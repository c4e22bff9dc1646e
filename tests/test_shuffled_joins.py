"""Tables made by explode are not broadcast, since Spark's estimate of them is too low."""

import pytest

import __spark_entry__ as contract

NAMES = [
    "vertex_normals", "mesh_orient_faces", "mesh_flip_edges", "mesh_match_single_edges", "mesh_cut_oblique", "border_paths_in_order", "border_segments_between_flats", "mesh_borders_of_regions",
    "hull_membership", "mesh_find_flats", "mesh_part_overused_edges", "mesh_sliver_normals", "mesh_subdivide", "mesh_to_origin_and_inside_out", "slice_loops",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_broadcast_of_exploded_tables(spark, data, name):
    plan = contract.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "Join" not in plan
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tables_of_shapes_are_dealt_to_all_tasks(spark, data):
    from geoloom.plans import bindings as bd

    assert bd.table(spark, data, "part").rdd.getNumPartitions() == 4
