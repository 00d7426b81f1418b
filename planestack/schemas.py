"""Schemas of the data model: volumes, pixels, masks, catalogs, norms, points and refinement histories."""

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


VOXEL = _struct(vol_id=StringType(), z=LongType(), y=LongType(), x=LongType(), v=DoubleType())
CHUNK = _struct(cz=IntegerType(), cy=IntegerType(), cx=IntegerType(), origin=ArrayType(LongType()), shape=ArrayType(LongType()), dtype=StringType(), data=BinaryType())
PIXEL = _struct(img_id=LongType(), y=LongType(), x=LongType(), r=IntegerType(), g=IntegerType(), b=IntegerType())
MASK = _struct(img_id=LongType(), y=LongType(), x=LongType(), label=LongType())
NORMS = _struct(dataset=StringType(), min=DoubleType(), max=DoubleType(), inverted=BooleanType(), set_norm=BooleanType())
POINT = _struct(x=IntegerType(), y=IntegerType(), label=IntegerType(), instance=IntegerType())
PARAMS = _struct(prompt=StringType(), num_inference_steps=IntegerType(), guidance_scale=DoubleType(), strength=DoubleType(), seed=LongType(), threshold=IntegerType(), extra=MapType(StringType(), StringType()))
SCORES = _struct(tp_rate=DoubleType(), fp_rate=DoubleType(), fn_rate=DoubleType(), boundary_quality=DoubleType(), dice_score=DoubleType())
EVALUATION = _struct(score=DoubleType(), detailed=SCORES, issues=ArrayType(StringType()), refined_prompt=StringType(), should_stop=BooleanType(), reasoning=StringType())
CLASS_INFO = _struct(path=StringType(), resolution=ArrayType(DoubleType()), offset=ArrayType(DoubleType()), shape=ArrayType(LongType()))
CROP = _struct(dataset=StringType(), crop_id=StringType(), annotated_classes=ArrayType(StringType()), class_info=MapType(StringType(), CLASS_INFO), crop_origin=ArrayType(DoubleType()), crop_extent=ArrayType(DoubleType()))
ITERATION = _struct(run_id=LongType(), iteration=IntegerType(), score=DoubleType())
