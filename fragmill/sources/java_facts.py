"""Facts of Java frameworks: which annotations imply which more general ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# An annotation and those it is composed of.
META_ANNOTATIONS: dict[str, tuple[str, ...]] = {
    "@RestController": ("@Controller", "@ResponseBody", "@Component"),
    "@Controller": ("@Component",),
    "@Service": ("@Component",),
    "@Repository": ("@Component",),
    "@Configuration": ("@Component",),
    "@GetMapping": ("@RequestMapping",),
    "@PostMapping": ("@RequestMapping",),
    "@PutMapping": ("@RequestMapping",),
    "@DeleteMapping": ("@RequestMapping",),
    "@PatchMapping": ("@RequestMapping",),
    "@SpringBootApplication": ("@Configuration", "@ComponentScan", "@EnableAutoConfiguration"),
    "@SpringBootTest": ("@ExtendWith",),
    "@Cacheable": ("@Caching",),
    "@CacheEvict": ("@Caching",),
    "@CachePut": ("@Caching",),
    "@NotNull": ("@Constraint",),
    "@NotBlank": ("@Constraint",),
    "@NotEmpty": ("@Constraint",),
    "@Size": ("@Constraint",),
    "@Valid": ("@Constraint",),
    "@Validated": ("@Constraint",),
    "@Entity": ("@Table",),
    "@Id": ("@Column",),
    "@Test": ("@Testable",),
    "@ParameterizedTest": ("@Testable",),
}


def direct_annotations(spark: SparkSession) -> DataFrame:
    """specific and general, one row for each direct relation."""
    return spark.createDataFrame([(s, g) for s, all_ in META_ANNOTATIONS.items() for g in all_], "specific string, general string")
