"""Explicit schemas of the tables that operators exchange."""

from __future__ import annotations

READS = "qname string, flag int, contig string, pos long, mapq int, cigar string, seq string, qual binary, tags map<string,string>"
EVENT = "struct<pos:long,op:string,len:int,qi:int,alt:string,low_qual:boolean>"
INTERVALS = "contig string, st long, en long, label int"
SITES = "contig string, pos long, vtype int, ref_len int, alt_len int, alt_seq string"
CALLS = (
    "contig string, pos long, ref string, alt string, qual int, gt string, dp int, ref_ad int, alt_ad int, gq int, ps long, "
    "clean boolean, somatic boolean, mei boolean, end long, svtype string, svlen int, tsd string, tsdlen int, polyalen int, tsdpos1 long, tsdpos2 long, repname string"
)
#: Variant types are alignment operation codes: sites sort by them.
INS, DEL, SNP = 1, 2, 8
SITE_KEY = ["contig", "pos", "vtype", "ref_len", "alt_len", "alt_seq"]
