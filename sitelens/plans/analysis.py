"""All per-site analyses over one set of pages and style sheets, built once per plan."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.operators import a11y as A
from sitelens.operators import components as CP
from sitelens.operators import corpus as C
from sitelens.operators import layout as LY
from sitelens.operators import risks as RK
from sitelens.operators import stack as S
from sitelens.operators import tokens as T
from sitelens.session import materialize


class SiteAnalysis:
    """Per-site extraction results (the reference's ExtractionResult, as tables keyed by ``site``).

    pages: site, page_ord, url, html — the analysed pages (failed fetches carry ``html = ''``).
    css:   site, css_ord, css_url, css — fetched external style sheets, or None.
    sites: site — every analysed site (empty sites still get a11y rows, ``unknown`` grid, …).
    robots: site, robots_status — optional.
    """

    def __init__(self, pages: DataFrame, css: DataFrame | None, sites: DataFrame, robots: DataFrame | None = None,
                 shared: bool = True):
        self.pages, self.css_assets, self.sites, self._robots = pages, css, sites, robots
        self._shared = shared

    def _share(self, df: DataFrame, name: str) -> DataFrame:
        """Intermediates read by many branches are written once (one HTML scan each, not one per branch)."""
        return materialize(df, name) if self._shared else df

    @cached_property
    def css(self) -> DataFrame | None:
        return C.external_css(self.css_assets)

    @cached_property
    def corpus(self) -> DataFrame:
        return self._share(C.css_corpus(self.pages, self.css_assets), "corpus")

    @cached_property
    def decls(self) -> DataFrame:
        return T.declarations(self.corpus)

    @cached_property
    def tokens(self) -> DataFrame:
        return self._share(T.tokens(self.corpus), "tokens")

    @cached_property
    def properties(self) -> DataFrame:
        return T.of_kind(self.tokens, "custom_property")

    @cached_property
    def colors(self) -> DataFrame:
        return T.of_kind(self.tokens, "color")

    @cached_property
    def fonts(self) -> DataFrame:
        return T.of_kind(self.tokens, "font")

    @cached_property
    def radii(self) -> DataFrame:
        return T.of_kind(self.tokens, "radius")

    @cached_property
    def shadows(self) -> DataFrame:
        return T.of_kind(self.tokens, "shadow")

    @cached_property
    def headings(self) -> DataFrame:
        return T.heading_scale(self.corpus)

    @cached_property
    def body(self) -> DataFrame:
        return T.body_text(self.corpus)

    @cached_property
    def families(self) -> DataFrame:
        return self.fonts.withColumn("confidence", F.lit(P.CONF_FONT_FAMILY_SCALE))

    @cached_property
    def hits(self) -> DataFrame:
        return self._share(S.pattern_hits(C.content_corpus(self.pages, self.css_assets)), "pattern-hits")

    @cached_property
    def signals(self) -> DataFrame:
        return S.ranked_stack(S.stack_signals(self.hits))

    @cached_property
    def signal_sources(self) -> DataFrame:
        return S.signal_sources(self.hits)

    @cached_property
    def component_matches(self) -> DataFrame | None:
        return None if self.css is None else CP.component_matches(self.css)

    @cached_property
    def component_classes(self) -> DataFrame | None:
        m = self.component_matches
        return None if m is None else CP.component_classes(m)

    @cached_property
    def component_states(self) -> DataFrame | None:
        m = self.component_matches
        return None if m is None else CP.component_states(CP.component_samples(m), CP.state_pieces(self.css))

    @cached_property
    def a11y(self) -> DataFrame:
        return A.a11y_report(self._share(A.site_a11y(self.sites, self.pages, self.css), "a11y"))

    @cached_property
    def container_widths(self) -> DataFrame | None:
        return None if self.css is None else LY.container_widths(self.css)

    @cached_property
    def breakpoints(self) -> DataFrame | None:
        return None if self.css is None else LY.breakpoints(self.css)

    @cached_property
    def grid(self) -> DataFrame:
        return LY.grid_system(self.sites, self.css)

    @cached_property
    def robots(self) -> DataFrame:
        if self._robots is not None:
            return self._robots
        return self.sites.select("site", F.lit("allowed").alias("robots_status"))

    @cached_property
    def risks(self) -> DataFrame:
        facts = RK.site_facts(self.sites, self.colors, self.signals, self.robots, self.pages, self.css)
        return RK.risk_list(facts)

    @cached_property
    def notes(self) -> DataFrame:
        return RK.note_list(RK.note_facts(self.sites, self.pages, self.css))

